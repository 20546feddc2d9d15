"""Line dedup over overlapping windows of three lines.

Every run of ``width`` consecutive lines is hashed (two 64-bit hashes). A
window that occurs before, in document order and then position, is a later
occurrence: all its lines go. Covered positions are merged into ranges, and the
text is rebuilt from what lies between them.

All DataFrame functions: windows are exploded as (hash, document, position),
never with their text, and written; the rows of one hash meet in one task, but
for hashes that many rows have, whose first occurrence is found before any
shuffle. The text itself is shuffled once, to meet its own document's ranges.

Defined cases: null text has no lines and stays null; an empty text is one
empty line; documents of fewer than ``width`` lines are left alone; windows of
blank lines only do not count; rows that share both id and text are one
document and get the same result; null ids sort last. Extra columns pass
through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import later_occurrences, materialise, order_key

P = "__lf_"


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(order, text hash, position, k1, k2) of every window that has a line with letters, digits or marks."""
    h = F.transform(
        F.col(P + "lines"),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("\u0001"), x).alias("b"), (F.length(F.trim(x)) > 0).cast("int").alias("c")),
    )

    def window(i):
        at = [F.get(F.col(P + "h"), i + F.lit(j)) for j in range(width)]
        return F.struct(
            i.cast("int").alias("pos"),
            F.xxhash64(*[x["a"] for x in at]).alias("k1"),
            F.xxhash64(*[x["b"] for x in at]).alias("k2"),
            sum((x["c"] for x in at), F.lit(0)).alias("c"),
        )

    n = F.size(P + "lines")
    return (
        docs.filter(n >= width)
        .select(P + "ord", P + "th", h.alias(P + "h"))
        .select(P + "ord", P + "th", F.explode(F.transform(F.sequence(F.lit(0), F.size(P + "h") - width), window)).alias("w"))
        .filter(F.col("w.c") > 0)
        .select(F.col(P + "ord").alias("ord"), F.col(P + "th").alias("th"), "w.pos", "w.k1", "w.k2")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_lines``, ``n_removed`` added (replacing columns so named)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(f"c{kept.index(text_col)}")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], order_key(F.col(f"`{id_col}`")).alias(P + "ord")).select("*", F.xxhash64(text).alias(P + "th"), _lines(text).alias(P + "lines"))
    windows = materialise(_windows(base, width), "line-windows")
    later = later_occurrences(windows, ("k1", "k2"), ["ord", "th", "pos"])
    p = F.col("p")
    ranges = (
        later.groupBy("ord", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("p"))
        .select(
            F.col("ord").alias(P + "ord"),
            F.col("th").alias(P + "th"),
            F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, i - 1) + width)).alias(P + "from"),
            F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + width)), lambda x: x + width).alias(P + "to"),
        )
    )
    n = F.size(P + "lines")
    start = F.concat(F.array(F.lit(0)), F.col(P + "to"))
    end = F.concat(F.col(P + "from"), F.array(n))
    between = F.flatten(F.transform(F.arrays_zip(start.alias("s"), end.alias("e")), lambda r: F.slice(F.col(P + "lines"), r["s"] + 1, r["e"] - r["s"])))
    touched = F.col(P + "from").isNotNull()
    out = base.join(ranges, [P + "ord", P + "th"], "left").withColumn(P + "kept", F.when(touched, between))
    return out.select(
        *[(F.when(touched, F.array_join(P + "kept", "\n")).otherwise(text) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept)],
        n.cast("long").alias("n_lines"),
        F.when(touched, n - F.size(P + "kept")).otherwise(0).cast("long").alias("n_removed"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d)),
r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w
  WHERE length(trim(replace(k, chr(10), ' '))) > 0),
c AS (
  SELECT DISTINCT doc_id, p + j AS p FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM d),
k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY l.p) AS text FROM l ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
x AS (
  SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
