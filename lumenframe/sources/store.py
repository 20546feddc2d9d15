"""Sources and sinks: cached scans, a named store with column pruning, versioned artifacts with content hashes, resumable blocks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def query_key(query: str) -> str:
    """White space aside, the same query has the same key."""
    return hashlib.sha256(" ".join(query.split()).encode()).hexdigest()[:24]


def cached_query(spark: SparkSession, query: str, cache: str, refresh: bool = False) -> DataFrame:
    """The rows of an SQL query from ``cache``, run and written there first if they are not (all of them: ``_SUCCESS`` is the sign)."""
    path = f"{cache}/{query_key(query)}"
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        spark.sql(query).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


class Store:
    """Named tables in one folder; ``load`` reads only the columns asked for and names what is missing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{self.root}/{name}")

    def load(self, name: str, columns: list[str] | None = None) -> DataFrame:
        if not exists(self.spark, f"{self.root}/{name}"):
            raise FileNotFoundError(f"no table {name} in {self.root}; save it first")
        df = self.spark.read.parquet(f"{self.root}/{name}")
        missing = [c for c in columns or [] if c not in df.columns]
        if missing:
            raise KeyError(f"{name} has no column {', '.join(missing)}")
        return df.select(*columns) if columns else df


def content_hash(value) -> str:
    """Of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save_artifact(spark: SparkSession, root: str, parts: dict[str, dict]) -> str:
    """JSON parts under a folder named by their hash, then the manifest; the id is returned. Nothing is ever replaced."""
    manifest = {name: content_hash(part) for name, part in sorted(parts.items())}
    ident = content_hash(manifest)[:16]
    rows = [(name, json.dumps(part, sort_keys=True)) for name, part in sorted(parts.items())]
    if not exists(spark, f"{root}/{ident}/_SUCCESS"):
        spark.createDataFrame(rows, "name string, body string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{ident}")
    return ident


def load_artifact(spark: SparkSession, root: str, ident: str) -> dict[str, dict]:
    """The parts, refused if their hashes do not make the id."""
    parts = {r["name"]: json.loads(r["body"]) for r in spark.read.parquet(f"{root}/{ident}").collect()}
    manifest = {name: content_hash(part) for name, part in sorted(parts.items())}
    if content_hash(manifest)[:16] != ident:
        raise ValueError(f"artifact {ident} was changed")
    return parts


def point_to(spark: SparkSession, root: str, name: str, ident: str) -> None:
    """Append to a pointer's history; ``resolve`` reads the last, ``resolve(back=1)`` the one before."""
    n = spark.read.json(f"{root}/pointers/{name}").count() if exists(spark, f"{root}/pointers/{name}") else 0
    spark.createDataFrame([(n, ident)], "n long, ident string").coalesce(1).write.mode("append").json(f"{root}/pointers/{name}")


def resolve(spark: SparkSession, root: str, name: str, back: int = 0) -> str:
    rows = spark.read.schema("n long, ident string").json(f"{root}/pointers/{name}").orderBy(F.desc("n")).limit(back + 1).collect()
    if len(rows) <= back:
        raise LookupError(f"pointer {name} has no version {back} back")
    return rows[back]["ident"]


def run_blocks(df: DataFrame, block: str, directory: str, fetch, identity: str) -> DataFrame:
    """``fetch`` (rows of a block to rows) for each block that has no result yet; a block's result is whole or absent.

    Blocks are keyed by ``identity`` and their number, so a changed request never reads another's results. All blocks
    that are open are written in one job, a folder each; a second call finds them done.
    """
    spark = df.sparkSession
    path = f"{directory}/{content_hash(identity)[:16]}"
    open_rows = df
    if exists(spark, f"{path}/_done"):
        open_rows = df.join(spark.read.parquet(f"{path}/_done").distinct(), block, "left_anti")
    todo = open_rows.select(block).distinct()
    if todo.take(1):
        todo = todo.checkpoint() if spark.sparkContext.getCheckpointDir() else todo
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            fetch(open_rows).write.mode("overwrite").partitionBy(block).parquet(f"{path}/rows")
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        todo.write.mode("append").parquet(f"{path}/_done")
    return spark.read.parquet(f"{path}/rows")


def plan_uses(df: DataFrame, *nodes: str) -> bool:
    """Whether the physical plan has one of these operators; a guard against accidental products and full sorts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(n in plan for n in nodes)


def read_filter_curve(spark: SparkSession, path: str) -> DataFrame:
    """(wavelength, transmission) of a VOTable's rows, by the built-in XML reader; negative transmissions are 0."""
    rows = spark.read.format("xml").option("rowTag", "TR").schema("TD array<double>").load(path)
    return rows.select(F.get("TD", F.lit(0)).alias("wavelength"), F.greatest(F.get("TD", F.lit(1)), F.lit(0.0)).alias("transmission")).filter("wavelength is not null").orderBy("wavelength")


def same_configuration(a: dict, b: dict, relocatable: dict[str, str]) -> bool:
    """Equal but for the places of input files: ``relocatable`` gives the key that holds the content hash for each key that holds a path.

    A path may differ where both sides carry the same hash.
    """
    if set(a) != set(b):
        return False
    moved = [k for k in a if a[k] != b[k]]
    return all(k in relocatable and a.get(relocatable[k]) is not None and a.get(relocatable[k]) == b.get(relocatable[k]) for k in moved)
