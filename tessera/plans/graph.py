"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import graph as G
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, key, nodes, table

ATTENUATION_SQL = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.ATTENUATION.items()) + " ELSE 0.5 END"
BOTH_SQL = "steps AS (SELECT source AS src, target AS dst, id AS edge_id FROM used UNION ALL SELECT target, source, id FROM used)"


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"WITH {NODES_SQL} SELECT * FROM nodes")
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir)


@query(f"WITH {EDGES_SQL} SELECT id, source, target, edge_type, round(weight + 1e-9, 6) AS weight, confidence FROM edges")
def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("weight", F.round(F.col("weight") + 1e-9, 6))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, kept AS (SELECT * FROM nodes WHERE NOT (node_type = 'Class' AND access_count = 0))
SELECT edge_type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) GROUP BY edge_type""")
def dangling_edges_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = nodes(spark, sf_dir)
    gone = all_nodes.filter("node_type = 'Class' AND access_count = 0")
    _, kept = G.remove_nodes(all_nodes, edges(spark, sf_dir), gone)
    return kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES_SQL}, ids AS (SELECT 'cust:' || c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey < 3)
SELECT id FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)""")
def edge_insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ids = customer.filter("c_nationkey < 5").select(key("cust", "c_custkey").alias("id")).union(nation.filter("n_nationkey < 3").select(key("nation", "n_nationkey")))
    all_edges = edges(spark, sf_dir)
    none = all_edges.filter("false")
    once = G.insert_edges(ids, none, all_edges)
    return G.insert_edges(ids, once, all_edges).select("id")


@query(f"WITH {EDGES_SQL} SELECT count(*) AS n_edges, round(coalesce(avg(weight), 0.5), 6) AS avg_weight, count(*) FILTER (WHERE weight >= 0.70) AS strong, count(*) FILTER (WHERE weight <= 0.15) AS weak, count(*) FILTER (WHERE confidence = 'proven') AS proven FROM edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stats(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM edges GROUP BY edge_type")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@query(f"""WITH {NODES_SQL} SELECT regexp_extract(file_path, 'crates/([^/]+)', 1) AS package, count(*) AS n, CAST(sum(token_cost) AS BIGINT) AS tokens, count(DISTINCT file_path) AS files
FROM nodes GROUP BY 1 ORDER BY n DESC, package LIMIT 16""")
def architecture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.paths import package_slug

    by = nodes(spark, sf_dir).groupBy(package_slug("file_path").alias("package"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("token_cost").alias("tokens"), F.count_distinct("file_path").alias("files")).orderBy(F.desc("n"), "package").limit(16)


@query(f"WITH {EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 12")
def degree_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("id")).union(e.select("target"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(12)


@query(f"WITH {EDGES_SQL} SELECT target AS id, count(*) AS callers FROM edges WHERE edge_type IN ('Calls', 'UsedBy', 'References') GROUP BY target")
def inbound_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.inbound(edges(spark, sf_dir))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, node_type FROM nodes WHERE node_type IN ('Function', 'Symbol', 'Api') AND id NOT IN (SELECT target FROM edges WHERE edge_type IN ('Calls', 'UsedBy', 'References', 'Imports'))")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = G.inbound(edges(spark, sf_dir), ("Calls", "UsedBy", "References", "Imports"))
    return nodes(spark, sf_dir).filter(F.col("node_type").isin("Function", "Symbol", "Api")).join(used, "id", "left_anti").select("id", "node_type")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT e.target AS id, string_agg(n.name || '@' || n.file_path, ';' ORDER BY n.name || '@' || n.file_path) AS readers
FROM edges e JOIN nodes n ON n.id = e.source WHERE e.edge_type = 'References' AND e.weight >= 0.98 GROUP BY e.target""")
def who_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    callers = edges(spark, sf_dir).filter("edge_type = 'References' AND weight >= 0.98").join(nodes(spark, sf_dir).select(F.col("id").alias("source"), F.concat_ws("@", "name", "file_path").alias("reader")), "source")
    return callers.groupBy(F.col("target").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("reader")), ";").alias("readers"))


@query(f"""WITH {EDGES_SQL} SELECT id, direction, count(*) AS n, round(sum(weight), 4) AS weight FROM (
SELECT source AS id, 'outgoing' AS direction, weight FROM edges UNION ALL SELECT target, 'incoming', weight FROM edges) GROUP BY id, direction""")
def neighbor_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_views(edges(spark, sf_dir)).groupBy("id", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"""WITH {EDGES_SQL}, ranked AS (SELECT source, target, round(weight * {ATTENUATION_SQL}, 6) AS score, id FROM edges)
SELECT source, place, target, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, target, id) AS INT) AS place FROM ranked) WHERE place <= 3""")
def next_node_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.next_nodes(edges(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, ids AS (SELECT 'cust:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'region:' || r_regionkey FROM region)
SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    ids = t("customer").filter("c_mktsegment = 'BUILDING'").select(key("cust", "c_custkey").alias("id"))
    ids = ids.union(t("nation").select(key("nation", "n_nationkey"))).union(t("region").select(key("region", "r_regionkey")))
    return G.induced(edges(spark, sf_dir), ids).select("id", "source", "target")


@query(f"""WITH {EDGES_SQL}, used AS (SELECT * FROM edges), {BOTH_SQL}, h0 AS (SELECT 'cust:1' AS id),
h1 AS (SELECT DISTINCT dst AS id FROM steps JOIN h0 ON src = h0.id WHERE dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT dst AS id FROM steps JOIN h1 ON src = h1.id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1))
SELECT id, 0 AS depth FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def k_hop_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(edges(spark, sf_dir), seeds(spark, "cust:1"), 2)


def trace_sql(steps: str, origin: str, kinds: str) -> str:
    return f"""WITH {EDGES_SQL}, used AS (SELECT * FROM edges WHERE edge_type IN ({kinds})), {steps}, h0 AS (SELECT '{origin}' AS id),
h1 AS (SELECT DISTINCT dst AS id FROM steps JOIN h0 ON src = h0.id WHERE dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT dst AS id FROM steps JOIN h1 ON src = h1.id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1)),
h3 AS (SELECT DISTINCT dst AS id FROM steps JOIN h2 ON src = h2.id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2)),
reached AS (SELECT id, 1 AS depth FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3)"""


OUT_SQL = "steps AS (SELECT source AS src, target AS dst FROM used)"
IN_SQL = "steps AS (SELECT target AS src, source AS dst FROM used)"
THREE = "'Calls', 'UsedBy', 'Imports'"
SCORED = " SELECT id, depth, round(1 - 0.12 * depth, 6) AS score FROM reached"


@query(trace_sql(OUT_SQL, "cust:1", THREE) + SCORED)
def trace_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trace(edges(spark, sf_dir), seeds(spark, "cust:1"), "out", 3)


@query(trace_sql(IN_SQL, "part:1", THREE) + SCORED)
def trace_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trace(edges(spark, sf_dir), seeds(spark, "part:1"), "in", 3)


@query(trace_sql(BOTH_SQL, "cust:1", THREE + ", 'Contains'") + SCORED)
def trace_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trace(edges(spark, sf_dir), seeds(spark, "cust:1"), "both", 3)


@query(trace_sql(BOTH_SQL, "cust:1", THREE + ", 'Contains'").replace("WITH ", f"WITH {NODES_SQL}, ", 1) + """, sized AS (SELECT count(*) AS symbols, count(DISTINCT file_path) AS files FROM reached JOIN nodes USING (id) WHERE depth <= 2)
SELECT symbols, files, CASE WHEN symbols >= 12 THEN 'high' WHEN symbols >= 5 THEN 'medium' ELSE 'low' END AS risk FROM sized""")
def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact(nodes(spark, sf_dir), edges(spark, sf_dir), seeds(spark, "cust:1"), 2)


PATH_SQL = f"""WITH {EDGES_SQL}, used AS (SELECT * FROM edges), {BOTH_SQL},
h0 AS (SELECT 'cust:1' AS id, ['cust:1'] AS path),
h1 AS (SELECT dst AS id, list_append(arg_min(path, (src, edge_id)), dst) AS path FROM steps JOIN h0 ON src = h0.id WHERE dst NOT IN (SELECT id FROM h0) GROUP BY dst),
h2 AS (SELECT dst AS id, list_append(arg_min(path, (src, edge_id)), dst) AS path FROM steps JOIN h1 ON src = h1.id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1) GROUP BY dst),
h3 AS (SELECT dst AS id, list_append(arg_min(path, (src, edge_id)), dst) AS path FROM steps JOIN h2 ON src = h2.id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2) GROUP BY dst),
found AS (SELECT id, 0 AS depth, path FROM h0 UNION ALL SELECT id, 1, path FROM h1 UNION ALL SELECT id, 2, path FROM h2 UNION ALL SELECT id, 3, path FROM h3)"""


@query(PATH_SQL + " SELECT id, depth, array_to_string(path, '>') AS path FROM found")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_paths(edges(spark, sf_dir), "cust:1", 3).withColumn("path", F.array_join("path", ">"))


@query(PATH_SQL + " SELECT DISTINCT unnest(path) AS id FROM found WHERE id IN ('cust:2', 'cust:3', 'part:1', 'part:2', 'supp:1', 'region:0', 'region:1')")
def steiner_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = ("cust:2", "cust:3", "part:1", "part:2", "supp:1", "region:0", "region:1")
    return G.steiner_union(edges(spark, sf_dir), "cust:1", others, 3)


SPREAD_SQL = f"""WITH {EDGES_SQL}, steps AS (SELECT source AS src, target AS dst, weight * {ATTENUATION_SQL} AS w FROM edges UNION ALL SELECT target, source, weight * {ATTENUATION_SQL} FROM edges),
f0 AS (SELECT 'cust:1' AS id, CAST(1.0 AS DOUBLE) AS energy UNION ALL SELECT 'cust:2', 0.8),
f1 AS (SELECT dst AS id, max(energy * 0.7 * w) AS energy FROM steps JOIN f0 ON src = f0.id WHERE energy * 0.7 * w >= 0.05 GROUP BY dst),
f2 AS (SELECT dst AS id, max(energy * 0.7 * w) AS energy FROM steps JOIN f1 ON src = f1.id WHERE energy * 0.7 * w >= 0.05 GROUP BY dst)
SELECT id, round(max(energy), 6) AS energy FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT id, energy * 0.85 FROM f2) GROUP BY id"""


@query(SPREAD_SQL)
def spreading_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("cust:1", 1.0), ("cust:2", 0.8)], "id string, energy double")
    return G.spread(edges(spark, sf_dir), start, 2)


@query(f"""WITH RECURSIVE {EDGES_SQL}, firsts AS (SELECT source, arg_min(target, id) AS target FROM edges WHERE edge_type = 'Calls' GROUP BY source),
chain AS (SELECT 0 AS step, 'cust:1' AS id UNION ALL SELECT step + 1, target FROM chain JOIN firsts ON source = chain.id WHERE step < 4) SELECT step, id FROM chain""")
def call_flow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_chain(edges(spark, sf_dir), "cust:1")


@query()
def physarum_tube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow from a customer to others of its nation through nations and regions; none beyond the kernel's bound."""
    e = edges(spark, sf_dir)
    home = e.filter("edge_type = 'DependsOn' AND source = 'cust:1'").select("target")
    near = e.filter("edge_type = 'DependsOn'").join(F.broadcast(home), "target", "left_semi")
    whole = near.select("source", "target", "weight").unionByName(e.filter("edge_type = 'Contains'").select("source", "target", "weight"))
    rows = sorted((r.source, r.target, r.weight) for r in whole.limit(G.TUBE_EDGES + 1).collect())  # one more tells that they are too many
    people = [a for a, _, _ in rows if a.startswith("cust:")]
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    tube = G.physarum(names, rows, ["cust:1", *[p for p in people if p != "cust:1"][:2]])
    return spark.createDataFrame([(a, b, round(q, 6)) for (a, b), q in sorted(tube.items())], "source string, target string, flux double")


@query(f"""WITH {EDGES_SQL}, ids AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT edge_type, count(*) AS n FROM edges WHERE target IN (SELECT id FROM ids) AND source NOT IN (SELECT id FROM ids) GROUP BY edge_type""")
def inbound_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(key("order", "o_orderkey").alias("id"))
    into = edges(spark, sf_dir).join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    return into.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT regexp_extract(n.file_path, 'crates/([^/]+)', 1) AS slug, count(*) AS n_edges, round(avg(e.weight), 6) AS avg_weight
FROM edges e JOIN nodes n ON n.id = e.source GROUP BY 1""")
def shard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges go with their source's package."""
    from tessera.functions.paths import package_slug

    owned = edges(spark, sf_dir).join(nodes(spark, sf_dir).select(F.col("id").alias("source"), package_slug("file_path").alias("slug")), "source")
    return owned.groupBy("slug").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@query(f"""WITH {NODES_SQL} SELECT sha256(string_agg(id || '|' || name, chr(10) ORDER BY id || '|' || name)) AS digest, count(*) AS n FROM nodes WHERE node_type IN ('File', 'Config')""")
def structural_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir).filter("node_type IN ('File', 'Config')").select(F.concat_ws("|", "id", "name").alias("x"))
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
