"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, fingerprints, html_extract, jaccard_join, language, line_dedup, merkle, mixing, packing, quality, substring_dedup, warc
from .common import crc_mod, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text without its later repeated windows."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, ranker)
    return scored.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = language.identify(docs, language.learn(docs))
    return said.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed_words, text without its later repeated runs of sentences."""
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "removed_words", "text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *vocabulary())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"n_chars": merkle.one_more()})


SQL9 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, min(hash(g)) AS m, bit_xor(hash(g)) AS x, sum(hash(g)) AS t FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, m, x, t) AS rep FROM n),
r AS (SELECT s.doc_id, g, n, count(*) OVER (PARTITION BY g) AS f FROM s JOIN c ON s.doc_id = c.doc_id AND c.rep = c.doc_id),
p AS (SELECT doc_id, g, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM r) WHERE k <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l AS (
  SELECT q.a, q.b FROM q JOIN r x ON x.doc_id = q.a JOIN r y ON y.doc_id = q.b AND x.g = y.g
  GROUP BY q.a, q.b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT DISTINCT rep AS u, rep AS v FROM c UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u),
m AS (SELECT u, min(v) AS root FROM t GROUP BY u)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.u = c.rep
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_quality, op3_language, op4_substring_dedup, op5_mixing, op6_packing, op7_html_extraction, op8_fingerprints, op9_jaccard_join, op10_nearest_neighbours,
            op11_warc, op12_collocations, op13_merkle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op9_jaccard_join": SQL9, "op11_warc": warc.SQL, "op12_collocations": collocations.SQL, "op13_merkle": merkle.SQL}
