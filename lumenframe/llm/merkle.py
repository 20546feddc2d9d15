"""Merkle manifest of a table by Pregel-style supersteps on RDDs.

A row is a leaf; the leaves of a group, in order, are the bottom of the group's
tree, and the groups' roots, in order, are the leaves of the tree of the whole
table. A vertex is a block of the tree, several levels of ``fanout`` at once, so that
2**40 leaves take four supersteps and no vertex holds more than ``block`` nodes.

Upward: every block sends its top digest to its parent; a parent that has heard
of all its children hashes its levels and forwards its own top; one that misses
a child fails the job. Downward, from the root: a block gets the siblings on the
way from its top to the root and sends each child its own, longer, list. At the
leaves a list is hashed into the proof's digest and folded with the (tampered)
leaf into a root.

Leaves are numbered by one range-partitioned sort; per partition, the first and
last group and their counts reach the driver. Blocks are written after each
upward step; the rest is recomputed from them. The supersteps are counted by the
largest group, the only other thing the driver learns.

Defined cases: null in any column is ``-``; null ids come first and are never
tampered; a null group is a group, the first; a null ``n_chars`` stays null;
rows that agree in every column are leaves of their own, in any order (their
rows of the result are the same in any); an empty table has no leaves and no
root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship

ship(__name__)

BLOCKS = "grp string, block long, n long, digests binary, ids array<long>, names array<string>, changed array<binary>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
SIZE = 32


def field(c: Column) -> Column:
    """A value with its length in bytes, or ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The 32 bytes of a row's digest."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def joined(nodes: list[bytes]) -> bytes:
    """Digest of digests, as hex text one after the other."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def cut(data: bytes) -> list[bytes]:
    return [data[i : i + SIZE] for i in range(0, len(data), SIZE)]


def levels(nodes: list[bytes], fanout: int, most: int) -> list[list[bytes]]:
    """The nodes and what stands on them, up to ``most`` levels or a single node."""
    out = [nodes]
    for _ in range(most):
        last = out[-1]
        out.append([joined(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def height(n: int, fanout: int, most: int) -> int:
    """Levels that a block stacks on its nodes, of a group with ``n`` nodes in this row: until one is left, if the block is the whole row."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // fanout), h + 1
    return h


def siblings(rows: list[list[bytes]], i: int, fanout: int) -> list[tuple[int, bytes]]:
    """For node ``i``, level by level: its place in its run and the run's other digests."""
    out = []
    for row in rows[:-1]:
        run = i // fanout * fanout
        out.append((i - run, b"".join(row[run:i] + row[i + 1 : run + fanout])))
        i //= fanout
    return out


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for place, others in path:
        others = cut(others)
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def place_of(k) -> int:
    """Where a vertex (group, block) lives; the same in every process."""
    return zlib.crc32(repr(k).encode())


def _summary(part: int, rows):
    """(partition, [(group, count) of its first and last group], largest count)."""
    first = last = None
    most = 0
    for g, n in ((g, sum(1 for _ in x)) for g, x in groupby(rows, key=lambda r: r[0])):
        first, last, most = first or (g, n), (g, n), max(most, n)
    if first:
        yield part, first, last, most


def _numbered(start: dict, totals: dict, block: int):
    """Sorted rows (group, digest, id, name, changed) as pieces ((group, block), (place, n, digests, ids, names, changed))."""

    def run(part: int, rows):
        for at, (g, members) in enumerate(groupby(rows, key=lambda r: r[0])):
            i = start.get(part, 0) if at == 0 else 0
            n = totals.get(g)
            members = iter(members)
            if n is None:  # the group lies within this partition
                members = list(members)
                n = len(members)
            for b, piece in groupby(enumerate(members, i), key=lambda r: r[0] // block):
                piece = list(piece)
                yield (g, b), (piece[0][0], n, b"".join(bytes(r[1]) for _, r in piece), [r[2] for _, r in piece], [r[3] for _, r in piece], [r[4] and bytes(r[4]) for _, r in piece])

    return run


def _whole(block: int):
    """A vertex of the bottom row from its pieces."""

    def run(item):
        (g, b), pieces = item
        pieces = sorted(pieces)
        n = pieces[0][1]
        digests = b"".join(p[2] for p in pieces)
        if len(digests) != SIZE * min(block, n - b * block):
            raise ValueError(f"block {b} of group {g} has {len(digests) // SIZE} of its nodes")
        return (g, b, n, digests, [x for p in pieces for x in p[3]], [x for p in pieces for x in p[4]], [x for p in pieces for x in p[5]])

    return run


class Forest:
    """The trees of the groups of sorted leaves: ``rows`` of blocks, one written table for each row of vertices, and ``roots``."""

    def __init__(self, leaves: DataFrame, order: list, fanout: int, depth: int):
        """``leaves``: grp, digest, id, name, changed; ``order`` sorts them within a group."""
        spark = leaves.sparkSession
        self.spark, self.fanout, self.depth, self.block = spark, fanout, depth, fanout**depth
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by = [F.asc_nulls_first("grp"), *order]
        ordered = leaves.repartitionByRange(self.parts, *by).sortWithinPartitions(*by).select("grp", "digest", "id", "name", "changed").rdd.map(tuple)
        start, totals, largest = self._spans(sorted(ordered.mapPartitionsWithIndex(_summary).collect(), key=lambda r: r[0]))
        pieces = ordered.mapPartitionsWithIndex(_numbered(start, totals, self.block))
        self.rows = [self._keep(pieces.groupByKey(self.parts, place_of).map(_whole(self.block)))]
        while largest > self.block:
            largest = -(-largest // self.block)
            self.rows.append(self._keep(self._tops(self.rows[-1], False).groupByKey(max(1, self.parts // self.block ** len(self.rows)), place_of).map(_whole(self.block))))

    @staticmethod
    def _spans(summary):
        """Where a partition's first group goes on, sizes of the groups that partitions share, and the largest size."""
        start, totals, largest = {}, {}, 0
        ends = [x for _, first, last, _ in summary for x in ([first] if first[0] == last[0] else [first, last])]
        for g, n in ends:
            totals[g] = totals.get(g, 0) + n
        seen: dict = {}
        for part, first, last, most in summary:
            start[part] = seen.get(first[0], 0)
            for g, n in [first] if first[0] == last[0] else [first, last]:
                seen[g] = seen.get(g, 0) + n
            largest = max(largest, most, totals[first[0]], totals[last[0]])
        return start, totals, largest

    def _keep(self, rdd) -> DataFrame:
        return materialise(self.spark.createDataFrame(rdd, BLOCKS, verifySchema=False), "merkle")

    def _tops(self, row: DataFrame, roots: bool):
        """What the blocks of a row send upward; of whole groups, the root."""
        fanout, depth, block = self.fanout, self.depth, self.block

        def run(r):
            g, b, n, digests = r
            if (n <= block) == roots:
                top = levels(cut(bytes(digests)), fanout, height(n, fanout, depth))[-1][0]
                yield (g, top) if roots else ((g, b // block), (b % block, -(-n // block), top, [None], [None], [None]))

        return row.select("grp", "block", "n", "digests").rdd.flatMap(run)

    def roots(self):
        """RDD of (group, root)."""
        found = self._tops(self.rows[0], True)
        for row in self.rows[1:]:
            found = found.union(self._tops(row, True))
        return found

    def down(self, given):
        """RDD of (block's columns, path above it, extra) of the bottom row, from ``given``: (group, (path above the root, extra))."""
        messages = given.map(lambda x: ((x[0], 0), (None, x[1])))
        fanout, depth, block = self.fanout, self.depth, self.block
        for k in range(len(self.rows) - 1, -1, -1):
            columns = ["grp", "block", "n", "digests"] + ["ids", "names", "changed"] * (k == 0)
            own = self.rows[k].select(*columns).rdd.map(lambda r: ((r[0], r[1]), (tuple(r), None)))
            met = own.union(messages).groupByKey(max(1, self.parts // self.block**k), place_of)
            if k:
                messages = met.flatMap(_onward(fanout, depth, block))
        return met.map(_met)


def _met(item):
    """(block's columns, path above it, extra) of a vertex that has met its message."""
    key, values = item
    values = list(values)
    if len(values) != 2:
        raise ValueError(f"block {key[1]} of group {key[0]} was not told of its siblings")
    own = next(x for x, _ in values if x is not None)
    return own, *next(y for x, y in values if x is None)


def _onward(fanout: int, depth: int, block: int):
    """The messages of a vertex to its children; one for a group whose root stands lower waits here and passes on."""

    def run(item):
        (g, b), values = item
        values = list(values)
        if len(values) == 1 and values[0][0] is None:
            yield (g, b), values[0]
            return
        (_, _, n, digests), path, extra = _met((item[0], values))
        rows = levels(cut(bytes(digests)), fanout, height(n, fanout, depth))
        for i in range(len(rows[0])):
            yield (g, b * block + i), (None, (siblings(rows, i, fanout) + path, extra))

    return run


def _leaves(fanout: int, depth: int):
    """Per leaf: (id, name, digest, path to the top, changed digest, extra)."""

    def run(item):
        (_, _, n, digests, ids, names, changed), path, extra = item
        rows = levels(cut(bytes(digests)), fanout, height(n, fanout, depth))
        for i, digest in enumerate(rows[0]):
            yield ids[i], names[i], digest, siblings(rows, i, fanout) + path, changed[i], extra

    return run


def _verdict(row):
    doc_id, _, digest, path, changed, (subroot, root) = row
    proof = hashlib.sha256("".join(others.hex() for _, others in path).encode()).hexdigest()
    again = folded(digest if changed is None else bytes(changed), path)
    return doc_id, digest.hex(), subroot.hex(), root.hex(), proof, again.hex(), again == root


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None, fanout: int = 2, depth: int = 10) -> DataFrame:
    """Leaf, roots and proof of every row, and the root folded from its leaf, or, where ``tampered`` changes a column, from the changed one."""
    spark: SparkSession = docs.sparkSession
    now = [F.col(f"`{c}`") for c in columns]
    other = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    digests = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf(*now).alias("digest"), leaf(*other).alias("other"), F.monotonically_increasing_id().alias("rid"))
    leaves = materialise(digests.select("grp", "id", "digest", F.lit(None).cast("string").alias("name"), F.when(F.col("other") != F.col("digest"), F.col("other")).alias("changed"), "rid"), "merkle-leaves")
    trees = Forest(leaves, [F.asc_nulls_first("id"), F.asc("digest"), F.asc("rid")], fanout, depth)
    subroots = spark.createDataFrame(trees.roots().map(lambda r: ("", r[1], None, r[0], None)), "grp string, digest binary, id long, name string, changed binary", verifySchema=False)
    whole = Forest(materialise(subroots, "merkle-roots"), [F.asc_nulls_first("name")], fanout, depth)
    told = whole.down(whole.roots().map(lambda r: (r[0], ([], r[1])))).flatMap(_leaves(fanout, depth)).map(lambda x: (x[1], (x[3], (x[2], x[5]))))
    found = trees.down(told).flatMap(_leaves(fanout, depth)).map(_verdict)
    return spark.createDataFrame(found, RESULT, verifySchema=False)


def one_more(id_col: str = "doc_id", count_col: str = "n_chars") -> Column:
    """The tampered count: one more where 7 divides the crc32 of the id in decimal."""
    c, i = F.col(f"`{count_col}`"), F.col(f"`{id_col}`")
    return F.when(F.crc32(i.cast("string").cast("binary")) % 7 == 0, (c.cast("decimal(20,0)") + 1).cast("string")).otherwise(c.cast("string"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda c, x: list_reduce([xor(c, x)] || range(0, 8), lambda y, j: xor(y >> 1, 3988292384 * (y & 1)))) AS crc
  FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
l AS (
  SELECT doc_id, lang, i, n, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen(CAST(n_chars + t AS VARCHAR)) || ':' || (n_chars + t), '-') || z) AS changed
  FROM (SELECT *, CAST(xor(crc, 4294967295) % 7 = 0 AS BIGINT) AS t FROM d)),
u AS (
  SELECT lang, 0 AS lv, i, leaf AS h, n FROM l
  UNION ALL
  SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lang, lv, i // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, lv FROM u WHERE n = 1),
v AS (
  SELECT 0 AS lv, i, subroot AS h, n FROM s
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM v WHERE n > 1 GROUP BY lv, i // 2, n),
p AS (
  SELECT doc_id, lang, 0 AS lv, i, n, changed AS h, '' AS proof FROM l
  UNION ALL
  SELECT p.doc_id, p.lang, p.lv + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN p.h WHEN p.i % 2 = 0 THEN p.h || u.h ELSE u.h || p.h END), proof || coalesce(u.h, '')
  FROM p LEFT JOIN u ON u.lang IS NOT DISTINCT FROM p.lang AND u.lv = p.lv AND u.i = xor(p.i, 1) WHERE p.n > 1),
q AS (
  SELECT p.doc_id, p.lang, 0 AS lv, s.i, s.n, p.h, p.proof FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT q.doc_id, q.lang, q.lv + 1, q.i // 2, (q.n + 1) // 2, sha256(CASE WHEN v.h IS NULL THEN q.h WHEN q.i % 2 = 0 THEN q.h || v.h ELSE v.h || q.h END), proof || coalesce(v.h, '')
  FROM q LEFT JOIN v ON v.lv = q.lv AND v.i = xor(q.i, 1) WHERE q.n > 1)
SELECT l.doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified
FROM l JOIN q ON q.doc_id = l.doc_id AND q.n = 1 JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM v WHERE n = 1) r
"""
