"""Snapshots of a graph: Parquet by package, unless nothing changed; last-wins merges; append-once facts and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.paths import package_slug
from tessera.sources.scratch import Store

EPOCH = 1


def digest(nodes: DataFrame, edges: DataFrame) -> str:
    """A digest of both tables that no order of rows changes: sums of row hashes, so nothing is collected."""
    out = []
    for df in (nodes, edges):
        row = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
        out.append(f"{row[0]}:{row[1]}")
    return "|".join(out)


def save(nodes: DataFrame, edges: DataFrame, path: str, known: str | None = None) -> str:
    """Writes both tables by package, edges with their source's; skips it if the digest is as known. Returns the digest."""
    now = digest(nodes, edges)
    if now != known:
        slugged = nodes.withColumn("slug", package_slug("file_path"))
        owned = edges.join(slugged.select(F.col("id").alias("source"), "slug"), "source", "left").select(*edges.columns, F.coalesce("slug", F.lit("none")).alias("slug"))
        slugged.withColumn("parser_epoch", F.lit(EPOCH)).write.mode("overwrite").partitionBy("slug").parquet(f"{path}/nodes")
        owned.write.mode("overwrite").partitionBy("slug").parquet(f"{path}/edges")
    return now


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables; nodes of another parser epoch don't come back, so they are parsed anew."""
    nodes = spark.read.parquet(f"{path}/nodes").filter(F.col("parser_epoch") == EPOCH).drop("parser_epoch", "slug")
    return nodes, spark.read.parquet(f"{path}/edges").drop("slug")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Shards side by side; of a repeated id the last shard's row stays."""
    both = [p.withColumn("_k", F.lit(i)) for i, p in enumerate(parts)]
    rows = both[0]
    for p in both[1:]:
        rows = rows.unionByName(p)
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("_k")))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r", "_k")


def append_once(spark: SparkSession, rows: DataFrame, path: str, key: str, keep: int | None = None, order: str = "ts") -> None:
    """Adds rows whose key isn't there yet; keeps the newest so many."""
    store = Store(spark, path)
    if (held := store.read()) is not None:
        rows = held.unionByName(rows.join(held.select(key), key, "left_anti").select(held.columns))
    once = rows.dropDuplicates([key])
    if keep:
        once = once.orderBy(F.desc(order), key).limit(keep)
    store.replace(once)
