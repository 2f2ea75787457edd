"""Queries of selection under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions.text import token_count
from tessera.operators import graph as G
from tessera.operators import select as S
from tessera.plans.text import COUNT
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, key, nodes, table

AS_OF = "1999-01-01"


@query(f"SELECT o_orderkey, round(greatest(0.2, least(1.0, exp(-date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') * ln(2.0) / 7.0))), 6) AS recency FROM orders")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.recency(age), 6).alias("recency"))


@query(f"SELECT o_orderkey, round(greatest(0.0, least(1.0, 0.9 * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.5 END * least(1.0, o_totalprice / 300000) * greatest(0.2, least(1.0, exp(-date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') * ln(2.0) / 7.0))) * 1.1)), 6) AS score FROM orders")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate"))
    sure = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.8).otherwise(0.5)
    score = S.relevance_score(F.lit(0.9), sure, F.least(F.lit(1.0), F.col("o_totalprice") / 300000), age, F.lit(1.1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 6).alias("score"))


@query("SELECT p_partkey, round(greatest(0.0, least(64.0, p_size + CASE WHEN contains(p_name, 'red') THEN 0.15 * p_size ELSE 0.0 END + p_retailprice / 100 + 2.5 + 0.5 - CASE WHEN p_type = 'ECONOMY' THEN 28.0 ELSE 0.0 END)), 6) AS score FROM part")
def unified_file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.unified_file_score(F.col("p_size"), F.contains("p_name", F.lit("red")), F.col("p_retailprice") / 100, F.lit(2.5), F.lit(0.5), F.when(F.col("p_type") == "ECONOMY", 28.0).otherwise(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""WITH one AS (SELECT l_orderkey AS task, l_partkey AS id, max(l_quantity / 50) AS energy, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task ORDER BY energy DESC, pos, id) AS place FROM one)
SELECT task, id, CAST(place AS INT) AS place, round(CASE WHEN n > 5 THEN energy / (1 + 0.08 * (place - 1)) ELSE energy END, 6) AS energy FROM r WHERE n <= 5 OR (place <= 5 AND energy >= 0.3)""")
def seed_cap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id"), (F.col("l_quantity") / 50).alias("energy"), F.col("l_linenumber").alias("pos"))
    return S.seed_rank(seeds)


@query("""WITH c AS (SELECT p_type AS task, p_brand AS package, p_name || p_partkey AS path, p_size + p_retailprice / 1000 AS score FROM part),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, package ORDER BY score DESC, path) AS k FROM c) WHERE k <= 2)
SELECT task, place, package, path FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task ORDER BY score DESC, path) AS INT) AS place FROM i) WHERE place <= 6""")
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.col("p_type").alias("task"), F.col("p_brand").alias("package"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") + F.col("p_retailprice") / 1000).alias("score"))
    return S.diversified(c)


GREEDY_SQL = """WITH RECURSIVE ranked AS (SELECT l_orderkey AS task, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS place, l_quantity AS q FROM lineitem), c AS (SELECT task, place, place AS id, CAST(q AS BIGINT) AS cost FROM ranked),
f AS (SELECT task, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, CAST(NULL AS INTEGER) AS id, false AS took FROM c GROUP BY task UNION ALL
SELECT f.task, f.place + 1, CASE WHEN used + cost <= 60 THEN used + cost ELSE used END, c.id, used + cost <= 60 FROM f JOIN c ON c.task = f.task AND c.place = f.place + 1)
SELECT task, max(used) OVER (PARTITION BY task) AS used, id FROM f QUALIFY took"""


@query(GREEDY_SQL)
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines under a budget: a line that doesn't fit is skipped, later ones may still fit."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), place.alias("place"), F.col("l_quantity").cast("long").alias("cost"))
    return S.greedy_fill(lines.withColumn("id", F.col("place")), 60)


@query("WITH r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM lineitem) SELECT l_orderkey, count(*) AS kept FROM r WHERE run <= 100 GROUP BY l_orderkey")
def packet_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet's cap drops from the tail only: here a running sum is right."""
    lines = table(spark, sf_dir, "lineitem").withColumn("run", F.expr("sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)"))
    return lines.filter("run <= 100").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {NODES_SQL}, f AS (SELECT file_path, coalesce(max(token_cost) FILTER (WHERE node_type = 'File'), max(token_cost)) AS t FROM nodes GROUP BY file_path) SELECT CAST(sum(t) AS BIGINT) AS tokens, count(*) AS files FROM f")
def unique_file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_file_tokens(nodes(spark, sf_dir))


@query(f"""SELECT stage, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT CAST({COUNT} AS BIGINT) AS tokens, CASE WHEN n_chars < 40 THEN 'too_short' WHEN lang <> 'en' THEN 'language' WHEN contains(lower(text), 'idiot') THEN 'unsafe' WHEN {COUNT} > 5000 THEN 'over_budget' ELSE 'kept' END AS stage FROM documents) GROUP BY stage""")
def drop_stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("too_short", F.col("n_chars") < 40), ("language", F.col("lang") != "en"), ("unsafe", F.contains(F.lower("text"), F.lit("idiot"))), ("over_budget", F.col("tokens") > 5000)]
    counted = table(spark, sf_dir, "documents").withColumn("tokens", token_count("text"))
    return counted.groupBy(S.drop_stage(rules).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS seeds, count(*) FILTER (WHERE o_orderstatus = 'P') AS missing, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS gaps FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT c_custkey, CASE WHEN seeds = 0 THEN 'no_seed_resolved' WHEN missing > 0 THEN 'partial' WHEN gaps > 0 THEN 'bounded' ELSE 'no_recorded_gap' END AS claim FROM c")
def coverage_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    c = joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("seeds"), F.count_if(F.col("o_orderstatus") == "P").alias("missing"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("gaps"))
    return c.select("c_custkey", S.coverage_claim(F.col("seeds"), F.col("missing"), F.col("gaps")).alias("claim"))


@query(f"WITH {EDGES_SQL}, packet AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') SELECT source AS caller, count(*) AS n FROM edges WHERE edge_type = 'Calls' AND target IN (SELECT id FROM packet) AND source NOT IN (SELECT id FROM packet) GROUP BY source")
def packet_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of the packet's nodes that the packet lacks."""
    packet = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(key("order", "o_orderkey").alias("id"))
    into = edges(spark, sf_dir).filter("edge_type = 'Calls'").join(packet.withColumnRenamed("id", "target"), "target", "left_semi").join(packet.withColumnRenamed("id", "source"), "source", "left_anti")
    return into.groupBy(F.col("source").alias("caller")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL}, packet AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 25) SELECT source, round(coalesce(avg(CASE WHEN target IN (SELECT id FROM packet) THEN 1.0 ELSE 0.0 END), 1.0), 6) AS coverage FROM edges WHERE edge_type = 'Imports' GROUP BY source")
def seed_call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = table(spark, sf_dir, "part").filter("p_size > 25").select(key("part", "p_partkey").alias("target"), F.lit(1.0).alias("hit"))
    called = edges(spark, sf_dir).filter("edge_type = 'Imports'").join(packet, "target", "left")
    return called.groupBy("source").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("coverage"))


@query(f"""WITH {EDGES_SQL}, d AS (SELECT source AS id, count(*) AS out_n, avg(weight) AS w FROM edges GROUP BY source), s AS (SELECT id, least(1.0, 0.35 * least(1.0, out_n / 8.0) + 0.45 * w + 0.20) AS sufficiency FROM d)
SELECT id, round(sufficiency + 1e-9, 6) AS sufficiency, sufficiency >= 0.7 AS sufficient FROM s""")
def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = edges(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"))
    value = F.least(F.lit(1.0), 0.35 * F.least(F.lit(1.0), F.col("n") / 8.0) + 0.45 * F.col("w") + 0.20)
    return by.select("id", F.round(value + 1e-9, 6).alias("sufficiency"), (value >= 0.7).alias("sufficient"))


@query()
def activation_with_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreading activation, modulated by the flow that the graph of nations carries; where it's beyond the kernel's bound, energies stay."""
    e = edges(spark, sf_dir)
    start = spark.createDataFrame([("cust:1", 1.0), ("cust:2", 0.8)], "id string, energy double")
    spread = G.spread(e, start, 2)
    ends = e.filter("edge_type IN ('DependsOn', 'Contains')").join(spread.select(F.col("id").alias("source")), "source", "left_semi").limit(G.TUBE_EDGES + 1).collect()  # one more tells that they are too many
    rows = sorted((r.source, r.target, r.weight) for r in ends)
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    if G.beyond_tube(names, rows):
        return spread
    tube = G.physarum(names, rows, ["cust:1", "cust:2"])
    flux: dict[str, float] = {}
    most = max(tube.values(), default=1.0)
    for (a, b), q in tube.items():
        flux[a], flux[b] = max(flux.get(a, 0.0), q / most), max(flux.get(b, 0.0), q / most)
    held = spark.createDataFrame(sorted(flux.items()), "id string, flux double")
    carried = spread.join(F.broadcast(held), "id", "left").withColumn("flux", F.coalesce("flux", F.lit(0.0)))
    return carried.select("id", F.round(F.least(F.lit(1.0), F.col("energy") * (0.65 + 0.35 * F.col("flux"))), 6).alias("energy"))


PROMOTED_SQL = """WITH c AS (SELECT p_brand AS task, p_partkey AS id, CAST(p_size AS DOUBLE) AS score, p_partkey % 20 AS bonus, 0.5 + p_partkey % 10 / 10.0 AS relevance FROM part),
kept AS (SELECT * FROM c WHERE relevance >= 0.55), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS place FROM kept),
weak AS (SELECT task, min(score) AS least FROM r WHERE place <= 4 GROUP BY task),
best AS (SELECT task, id, score + bonus AS lifted FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score + bonus DESC, id) AS k FROM r WHERE place > 4 AND bonus >= 14) WHERE k = 1),
swap AS (SELECT best.task, best.id FROM best JOIN weak USING (task) WHERE lifted > least + 1)
SELECT r.task, r.id, 'ranked' AS why FROM r LEFT JOIN swap s ON s.task = r.task WHERE place < 4 OR (place = 4 AND s.id IS NULL) UNION ALL SELECT task, id, 'learned' FROM swap"""


@query(PROMOTED_SQL)
def learned_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of a task by score, without those that were learned to be irrelevant; the last gives way to a learned one that beats it."""
    part = table(spark, sf_dir, "part")
    c = part.select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 20).alias("bonus"), (0.5 + F.col("p_partkey") % 10 / 10.0).alias("relevance"))
    return S.promoted(c.filter("relevance >= 0.55"), 4, 14, 1.0)
