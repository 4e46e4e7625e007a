"""Shared parts of the training-data operators: word rule, workspace, materialisation, components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The same pattern where DuckDB's RE2 reads it.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def workspace(spark: SparkSession) -> str:
    """A folder of this call's own below spark.checkpoint.dir, which every executor shares.

    Where that is unset (as in tests), it lies below the warehouse, on whatever file system that is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base.rstrip('/')}/inkweave-{uuid.uuid4().hex}"


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as Parquet into the shared workspace and read it back: this cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps, whose DataFrames nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete intermediate tables that no later step reads."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | Column = "text") -> Column:
    """Array of words of a text; null or blank text gives an empty array."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(F.coalesce(col, F.lit("")), f"^{GAP}", ""), GAP)
    return F.filter(parts, lambda w: w != "")


def word_count(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def unit_uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on key alone (md5, so that SQL engines agree on it)."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def components(edges: DataFrame, folder: str, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root), root being the smallest id.

    Large-star and small-star steps alternate until the edges stop changing. Each round is written to the
    shared folder. Every step aggregates with minimum (combined before the shuffle), and hot nodes are
    joined by sort-merge, whose skewed partitions Spark splits; no group is ever collected.
    """
    spark = edges.sparkSession
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialise(cur, folder, f"{name}-0")
    before = None
    for step in range(1, max_rounds + 1):
        # large star: each node hands its larger neighbours to its smallest neighbour (or itself)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links itself and its smaller neighbours to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = materialise(small, folder, f"{name}-{step}")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: edges still change after {max_rounds} rounds")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
