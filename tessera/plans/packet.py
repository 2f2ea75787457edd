"""The whole way from prompt to packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import packet as K
from tessera.plans.graph import ATTENUATION_SQL
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table

TOKENS_SQL = "list_filter(list_distinct(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(name, '[ #]', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-/\\\\.:]+')), lambda t: length(t) > 1)"
SEEDS_SQL = f"""{NODES_SQL}, {EDGES_SQL}, prompts AS (SELECT DISTINCT p_name || '@' || p_type AS task, 'fix the ' || p_name || ' of ' || lower(p_type) || ' in nation_1' AS prompt FROM part),
asked AS (SELECT task, list_filter(list_distinct(string_split_regex(lower(prompt), '[^a-z0-9]+')), lambda t: length(t) > 1) AS ts FROM prompts), words AS (SELECT task, len(ts) AS n, unnest(ts) AS token FROM asked),
idx AS (SELECT id, unnest({TOKENS_SQL}) AS token FROM nodes), hits AS (SELECT task, id, count(*) / max(n) AS energy FROM words JOIN idx USING (token) GROUP BY task, id),
seeds AS (SELECT task, id, energy FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY energy DESC, id) AS place FROM hits) WHERE place <= 5)"""
FILES_SQL = f"""{SEEDS_SQL}, views AS (SELECT source AS id, target AS neighbour, weight * {ATTENUATION_SQL} AS w FROM edges UNION ALL SELECT target, source, weight * {ATTENUATION_SQL} FROM edges),
reached AS (SELECT task, id, max(energy) AS energy FROM (SELECT * FROM seeds UNION ALL SELECT task, neighbour, energy * w FROM seeds JOIN views USING (id)) GROUP BY task, id),
by_file AS (SELECT task, file_path AS id, round(max(energy), 6) AS score, max(token_cost) AS cost FROM reached JOIN nodes USING (id) GROUP BY task, file_path),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS place FROM by_file) WHERE place <= 40)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("fix the "), "p_name", F.lit(" of "), F.lower("p_type"), F.lit(" in nation_1"))
    return table(spark, sf_dir, "part").select(F.concat_ws("@", "p_name", "p_type").alias("task"), text.alias("prompt")).distinct()


@query(f"WITH {SEEDS_SQL} SELECT task, id, round(energy, 6) AS energy FROM seeds")
def prompt_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.seeds(prompts(spark, sf_dir), nodes(spark, sf_dir)).withColumn("energy", F.round("energy", 6))


@query(f"WITH {FILES_SQL} SELECT task, CAST(place AS INT) AS place, id, score, cost FROM ranked")
def packet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.seeds(prompts(spark, sf_dir), nodes(spark, sf_dir))
    return K.files(K.surroundings(found, edges(spark, sf_dir)), nodes(spark, sf_dir)).select("task", "place", "id", "score", "cost")


@query(f"""WITH RECURSIVE {FILES_SQL}, f AS (SELECT task, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, false AS took FROM ranked GROUP BY task UNION ALL
SELECT f.task, f.place + 1, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, used + cost <= 200 FROM f JOIN ranked r ON r.task = f.task AND r.place = f.place + 1),
taken AS (SELECT task, count(*) FILTER (WHERE took) AS files, max(used) AS tokens FROM f GROUP BY task)
SELECT p.task, coalesce(s.n, 0) AS seeds, coalesce(c.n, 0) AS candidates, coalesce(files, 0) AS files, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens,
CASE WHEN coalesce(s.n, 0) = 0 THEN 'no_seed_resolved' WHEN coalesce(c.n, 0) > coalesce(files, 0) THEN 'bounded' ELSE 'no_recorded_gap' END AS claim
FROM prompts p LEFT JOIN (SELECT task, count(*) AS n FROM seeds GROUP BY task) s USING (task) LEFT JOIN (SELECT task, count(*) AS n FROM ranked GROUP BY task) c USING (task) LEFT JOIN taken USING (task)""")
def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.packets(prompts(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir))
