"""What the operators of this subpackage share: tables, lineage cuts, salts."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: ``[\x20\x09-\x0D]``.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
LAST_ID = 9223372036854775807


def ship(module_name: str) -> None:
    """Send a module's functions to Python workers by value, so that workers need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def give_back() -> None:
    """Give memory that this Python worker holds without using it back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """A function of batches that gives unused memory back after each 64 that it makes and at its end."""

    def whole(batches):
        for i, made in enumerate(run(batches)):
            yield made
            del made
            if i % 64 == 0:
                give_back()
        give_back()

    return whole


def narrow(batches, rows: int = 1024):
    """The batches in slices of at most ``rows`` rows, so that few rows at a time become Python objects; an empty batch stays one."""
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(a, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset: the context's own checkpoint folder, else a folder of one machine in local mode and the warehouse
    (which drivers and executors share) on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named and not sc.master.startswith("local"):
            named = spark.conf.get("spark.sql.warehouse.dir")
        if not named:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
            named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Folders that ``materialise`` has written, in order.
WRITTEN: list[str] = []


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _written(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)
    WRITTEN.append(path)


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors, and what follows sees the same rows however often it is recomputed. It goes with
    ``drop_written``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, tag: str) -> str:
    """An empty folder beside the written tables, as a full address; it goes as they do."""
    path = f"{shared_dir(spark)}/lumenframe/{tag}-{uuid.uuid4().hex}"
    fs, p = _folder(spark, path)
    fs.mkdirs(p)
    _written(spark, path)
    return fs.makeQualified(p).toString()


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written from number ``since`` on, but for the last ``keep``; frames that read them are then void."""
    for path in WRITTEN[since : len(WRITTEN) - keep]:
        fs, p = _folder(spark, path)
        fs.delete(p, True)
    del WRITTEN[since : len(WRITTEN) - keep]


def hot_keys(df: DataFrame, key: str, parts: int, most: int = 256) -> list[int]:
    """Values of a whole-number column that more than twice an even share of all rows (``1 / parts``) have, at most ``most`` of them.

    One pass of a mergeable sketch over all rows. The answer only decides how rows are dealt out, never what comes of
    them; it is bounded by ``most``, so it may be broadcast or written into a plan.
    """
    row = df.agg(F.expr(f"approx_top_k({key}, {most}, 16384)").alias("top"), F.count(key).alias("n")).first()
    return sorted(x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] > max(64, 2 * row["n"] / max(1, parts)))


def hot_hashes(df: DataFrame, key: str) -> list[int]:
    """``hot_keys`` of a column of any type, as hashes, for one of the session's shuffles."""
    return hot_keys(df.select(F.xxhash64(key).alias("h_")), "h_", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str, hot: list[int] | None = None) -> DataFrame:
    """``left`` (a written table) joined with ``right``, which has one row for each value of ``key``.

    Values of ``key`` that more than their share of ``left`` have (``hot_hashes``, if not given) are not dealt out: their
    rows of ``right`` are few and go to them.
    """
    hot = hot_hashes(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    here = F.xxhash64(key).isin(hot)
    return left.filter(~here).join(right, key, how).unionByName(left.filter(here).join(F.broadcast(right.filter(here)), key, how))


def later_occurrences(found: DataFrame, keys: tuple[str, str], order: list[str]) -> DataFrame:
    """The rows of ``found`` (a written table) that are not the first of their two-column key in the given order; no column may be null.

    Rows that agree in key and order are one occurrence. Most keys meet in one task each, in a stream. Keys with more than their share of rows
    never meet: their firsts are combined before the shuffle, are few, and go to the rows.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(found, keys[0], parts)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    plain = found.filter(~F.col(keys[0]).isin(hot)) if hot else found
    later = plain.withColumn("rank_", rank).filter("rank_ > 1").drop("rank_")
    if not hot:
        return later
    common = found.filter(F.col(keys[0]).isin(hot))
    here = F.struct(*order)
    # one row for each hot key: at most as many as ``hot_keys`` gives, but for hashes that agree in one half
    first = common.groupBy(*keys).agg(F.min(here).alias("first_"))
    return later.unionByName(common.join(F.broadcast(first), list(keys)).filter(here != F.col("first_")).drop("first_"))


def order_key(id_col: Column) -> Column:
    """Document order: by id, null ids last."""
    return F.coalesce(id_col.cast("long"), F.lit(LAST_ID))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
