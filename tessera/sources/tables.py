"""Adapters that show the driver's tables as a weighted property graph, vectors, text and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "node_type", "name", "file_path", "token_cost", "base_relevance", "access_count")
EDGE_COLUMNS = ("id", "source", "target", "edge_type", "weight", "confidence")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a small file dealt out to all cores: what is made of each row is far larger or dearer than the row, and a file is read by few tasks."""
    return df.repartition(max(24, 4 * df.sparkSession.sparkContext.defaultParallelism), *by)


def edge_id(source: Column, target: Column, kind: str) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(f"::{kind}"))


def _edges(df: DataFrame, source: Column, target: Column, kind: str, weight: Column, confidence: Column) -> DataFrame:
    return df.select(edge_id(source, target, kind).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), confidence.alias("confidence"))


def key(prefix: str, name: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(name).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, prefix: str, key_column: str, kind: str, label: Column, path: Column, cost: Column, relevance: Column, access: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            key(prefix, key_column).alias("id"), F.lit(kind).alias("node_type"), label.alias("name"), path.alias("file_path"),
            cost.cast("long").alias("token_cost"), relevance.cast("double").alias("base_relevance"), access.cast("long").alias("access_count"),
        )

    def path(package: str, column: str) -> Column:
        return F.concat(F.lit(f"crates/{package}/src/m"), (F.col(column) % 10).cast("string"), F.lit(".rs"))

    one, none = F.lit(1.0), F.lit(0)
    parts = [
        rows("customer", "cust", "c_custkey", "Class", F.col("c_name"), path("customer", "c_custkey"), 8 + F.col("c_custkey") % 40, 1 + F.col("c_custkey") % 5 * 0.1, F.col("c_custkey") % 7),
        rows("orders", "order", "o_orderkey", "Function", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), path("orders", "o_orderkey"), 8 + F.col("o_orderkey") % 60, one, F.col("o_orderkey") % 3),
        rows("part", "part", "p_partkey", "Symbol", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), path("part", "p_partkey"), 8 + F.col("p_size"), one, F.col("p_partkey") % 4),
        rows("supplier", "supp", "s_suppkey", "Api", F.col("s_name"), path("supplier", "s_suppkey"), F.lit(16), one, none),
        rows("nation", "nation", "n_nationkey", "File", F.col("n_name"), F.concat(F.lit("crates/geo/src/"), F.lower("n_name"), F.lit(".rs")), F.lit(80), one, none),
        rows("region", "region", "r_regionkey", "Config", F.col("r_name"), F.lit("crates/geo/tests/regions.toml"), F.lit(40), one, none),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct by id. Line items repeat an order's part or supplier: the first by line number stays."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, nation, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    state = F.when(F.col("o_orderstatus") == "F", "proven").when(F.col("o_orderstatus") == "O", "likely").otherwise("unresolved")

    def first(column: str) -> DataFrame:
        return items.groupBy("l_orderkey", column).agg(F.min(F.struct("l_linenumber", "l_quantity", "l_discount")).alias("x")).select("l_orderkey", column, "x.*")

    half, whole = F.lit(0.5), F.lit(1.0)
    parts = [
        _edges(orders, key("cust", "o_custkey"), key("order", "o_orderkey"), "Calls", F.greatest(F.lit(0.05), F.least(whole, F.col("o_totalprice") / 500000)), state),
        _edges(first("l_partkey"), key("order", "l_orderkey"), key("part", "l_partkey"), "Imports", F.greatest(F.lit(0.05), F.least(whole, F.col("l_quantity") / 50)), F.lit("likely")),
        _edges(first("l_suppkey"), key("order", "l_orderkey"), key("supp", "l_suppkey"), "References", 1 - F.col("l_discount"), F.lit("proven")),
        _edges(customer, key("cust", "c_custkey"), key("nation", "c_nationkey"), "DependsOn", half, F.lit("proven")),
        _edges(supplier, key("supp", "s_suppkey"), key("nation", "s_nationkey"), "UsedBy", half, F.lit("proven")),
        _edges(nation, key("region", "n_regionkey"), key("nation", "n_nationkey"), "Contains", whole, F.lit("proven")),
    ]
    return reduce(DataFrame.unionByName, parts)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive event types of a user; staying at one isn't a transition: (user_id, from, to)."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, sf_dir, "events").select("user_id", F.lag("event_type").over(order).alias("from"), F.col("event_type").alias("to"))
    return moved.filter("from IS NOT NULL AND from <> to")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("dir"), F.col("embedding").alias("v"))


NODES_SQL = """
nodes AS (
  SELECT 'cust:' || c_custkey AS id, 'Class' AS node_type, c_name AS name, 'crates/customer/src/m' || (c_custkey % 10) || '.rs' AS file_path, CAST(8 + c_custkey % 40 AS BIGINT) AS token_cost, CAST(1 + c_custkey % 5 * 0.1 AS DOUBLE) AS base_relevance, CAST(c_custkey % 7 AS BIGINT) AS access_count FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'Function', 'order_' || o_orderkey, 'crates/orders/src/m' || (o_orderkey % 10) || '.rs', 8 + o_orderkey % 60, 1.0, o_orderkey % 3 FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'Symbol', replace(p_name, ' ', '_'), 'crates/part/src/m' || (p_partkey % 10) || '.rs', 8 + p_size, 1.0, p_partkey % 4 FROM part
  UNION ALL SELECT 'supp:' || s_suppkey, 'Api', s_name, 'crates/supplier/src/m' || (s_suppkey % 10) || '.rs', 16, 1.0, 0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'File', n_name, 'crates/geo/src/' || lower(n_name) || '.rs', 80, 1.0, 0 FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'Config', r_name, 'crates/geo/tests/regions.toml', 40, 1.0, 0 FROM region
)"""
EDGES_SQL = """
edges AS (
  SELECT source || '->' || target || '::' || edge_type AS id, * FROM (
    SELECT 'cust:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'Calls' AS edge_type, greatest(0.05, least(1.0, o_totalprice / 500000)) AS weight, CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'O' THEN 'likely' ELSE 'unresolved' END AS confidence FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Imports', greatest(0.05, least(1.0, l_quantity / 50)), 'likely' FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_discount) AS k FROM lineitem) WHERE k = 1
    UNION ALL SELECT 'order:' || l_orderkey, 'supp:' || l_suppkey, 'References', 1 - l_discount, 'proven' FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_quantity, l_discount) AS k FROM lineitem) WHERE k = 1
    UNION ALL SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey, 'DependsOn', 0.5, 'proven' FROM customer
    UNION ALL SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'UsedBy', 0.5, 'proven' FROM supplier
    UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'Contains', 1.0, 'proven' FROM nation)
)"""
TRANSITIONS_SQL = """
transitions AS (
  SELECT * FROM (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "from", event_type AS "to" FROM events) WHERE "from" IS NOT NULL AND "from" <> "to"
)"""
