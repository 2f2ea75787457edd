"""Queries of learning state, transitions and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import learning as L
from tessera.operators.search import learning_bonus as bonus
from tessera.sources.tables import EDGES_SQL, NODES_SQL, TRANSITIONS_SQL, edges, key, nodes, table, transitions

KIND = "CASE event_type WHEN 'purchase' THEN 'reinforce' WHEN 'error' THEN 'penalise' ELSE 'evaporate' END"


@query(f"""WITH e AS (SELECT user_id AS key, list({KIND} ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id)
SELECT key, round(list_reduce(kinds_, lambda x, y: greatest(0.05, least(1.0, CASE WHEN y = 1 THEN x + 0.15 WHEN y = 2 THEN x - 0.10 ELSE x * 0.98 END))), 6) AS weight
FROM (SELECT key, list_concat([CAST(0.5 AS DOUBLE)], list_transform(kinds, lambda k: CAST(CASE k WHEN 'reinforce' THEN 1 WHEN 'penalise' THEN 2 ELSE 3 END AS DOUBLE))) AS kinds_ FROM e)""")
def pheromone_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(KIND)
    return L.pheromone_fold(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind")))


STDP_SQL = """pre AS (SELECT user_id AS id, ts FROM events WHERE event_type = 'view'), post AS (SELECT user_id AS id, ts, event_type = 'purchase' AS useful FROM events WHERE event_type IN ('purchase', 'error')),
p AS (SELECT pre.id, ((epoch_us(post.ts) // 1000) - (epoch_us(pre.ts) // 1000)) / 1000.0 AS dt, useful FROM pre JOIN post ON pre.id = post.id AND abs((epoch_us(post.ts) // 1000) - (epoch_us(pre.ts) // 1000)) <= 3600000)"""


@query(f"WITH {STDP_SQL} SELECT id, round(1e-9 + sum(CASE WHEN dt >= 0 THEN 0.20 * exp(-dt / 180) * CASE WHEN useful THEN 1.5 ELSE 1.0 END ELSE -0.15 * exp(dt / 180) END), 6) + 0.0 AS delta FROM p GROUP BY id")
def stdp_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of one user within the hour, before and after: hour buckets make the interval join an equality join."""
    events = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    pre = events.filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ms").alias("a"), F.explode(F.array(*[(F.expr("ms div 3600000") + i) for i in (-1, 0, 1)])).alias("hour"))
    post = events.filter("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("id"), F.col("ms").alias("b"), F.expr("ms div 3600000").alias("hour"), (F.col("event_type") == "purchase").alias("useful"))
    pairs = pre.join(post, ["id", "hour"]).filter(F.abs(F.col("b") - F.col("a")) <= 3600000)
    return L.stdp(pairs.select("id", ((F.col("b") - F.col("a")) / 1000.0).alias("dt"), "useful"))


@query(f"WITH {EDGES_SQL}, s AS (SELECT *, sum(weight) OVER (PARTITION BY target) AS total FROM edges) SELECT id, round(greatest(0.05, least(1.0, CASE WHEN total > 3.5 THEN weight * 3.5 / total ELSE weight END)) + 1e-9, 6) AS weight FROM s")
def homeostasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.homeostasis(edges(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT id, round(greatest(0.0, 5 * ln(1 + access_count) + 10 * greatest(base_relevance - 1, 0.0) - 12 * greatest(1 - base_relevance, 0.0)), 6) AS bonus FROM nodes")
def learning_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", F.round(bonus("access_count", "base_relevance"), 6).alias("bonus"))


@query(f"WITH {TRANSITIONS_SQL}, c AS (SELECT \"from\", \"to\", count(*) AS n FROM transitions GROUP BY ALL) SELECT \"from\", \"to\", n, round(n / sum(n) OVER (PARTITION BY \"from\"), 6) AS p FROM c")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transition_shares(transitions(spark, sf_dir))


SHARES_SQL = f"{TRANSITIONS_SQL}, c AS (SELECT \"from\", \"to\", count(*) AS n FROM transitions GROUP BY ALL), s AS (SELECT \"from\", \"to\", round(n / sum(n) OVER (PARTITION BY \"from\"), 6) AS p FROM c)"


@query(f"WITH {SHARES_SQL} SELECT * FROM (SELECT \"from\", CAST(row_number() OVER (PARTITION BY \"from\" ORDER BY p DESC, \"to\") AS INT) AS place, \"to\", p FROM s WHERE p >= 0.15) WHERE place <= 3")
def predict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.predict_next(transitions(spark, sf_dir))


@query(f"""WITH {SHARES_SQL}, h1 AS (SELECT * FROM s), h2 AS (SELECT a."from", b."to", max(a.p * b.p) AS p FROM h1 a JOIN s b ON a."to" = b."from" WHERE a."from" <> b."to" GROUP BY ALL),
h3 AS (SELECT a."from", b."to", max(a.p * b.p) AS p FROM h2 a JOIN s b ON a."to" = b."from" WHERE a."from" <> b."to" GROUP BY ALL), e AS (SELECT "from", "to", round(max(p), 6) AS p FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL)
SELECT * FROM (SELECT "from", CAST(row_number() OVER (PARTITION BY "from" ORDER BY p DESC, "to") AS INT) AS place, "to", p FROM e) WHERE place <= 5""")
def multi_hop_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.multi_hop(transitions(spark, sf_dir))


@query(f"WITH {SHARES_SQL} SELECT * FROM (SELECT \"from\", \"to\", round(p * power(0.97, 50), 6) AS w FROM s) WHERE w > 0.05")
def decay_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.decay_trails(L.transition_shares(transitions(spark, sf_dir)).select("from", "to", F.col("p").alias("w")), 50)


@query("WITH e AS (SELECT conv_id, max(turn) AS turns, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user') AS summary FROM conversations GROUP BY conv_id) SELECT conv_id, turns FROM e WHERE contains(lower(summary), 'the') ORDER BY turns DESC, conv_id LIMIT 10")
def episodes_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten episodes whose summary holds the words asked for."""
    said = F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    episodes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.array_join(said["text"], " ").alias("summary"))
    return episodes.filter(F.contains(F.lower("summary"), F.lit("the"))).orderBy(F.desc("turns"), "conv_id").select("conv_id", "turns").limit(10)


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def episodes_unreplayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode is applied once: those that are marked don't come again."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id").distinct().join(turns.filter("turn >= 4").select("conv_id").distinct(), "conv_id", "left_anti")


@query("SELECT conv_id || ':' || role AS fact, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def project_facts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's key has one value, the last."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x"))
    return last.select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("fact"), "x.turn", "x.text")


@query("SELECT source || ':' || lang AS pattern, CAST(sum(quality) AS BIGINT) AS successes, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def collective_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return seen.groupBy(F.concat_ws(":", "source", "lang").alias("pattern")).agg(F.sum("quality").cast("long").alias("successes"), F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant') SELECT conv_id, turn FROM r WHERE k <= 10")
def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten results of each conversation."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return said.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("k <= 10").select("conv_id", "turn")


@query("""WITH o AS (SELECT user_id AS key, list(event_type ORDER BY ts, event_id) AS kinds FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT key, round(list_reduce(list_concat([CAST(1.0 AS DOUBLE)], list_transform(kinds, lambda k: CAST(CASE k WHEN 'purchase' THEN 5 ELSE 7 END AS DOUBLE))), lambda x, y: CASE WHEN y = 5 THEN least(3.0, x + 0.08) ELSE greatest(0.1, x - 0.12) END), 6) AS relevance, CAST(len(list_filter(kinds, lambda k: k = 'purchase')) AS BIGINT) AS accesses FROM o""")
def node_access_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance up by 0.08 to 3 at most, or down by 0.12 to 0.1 at least, in order."""
    good = F.col("event_type") == "purchase"
    step = F.struct(F.lit(1.0).alias("a"), F.when(good, 0.08).otherwise(-0.12).alias("b"), F.when(good, -1e300).otherwise(0.1).alias("lo"), F.when(good, 3.0).otherwise(1e300).alias("hi"))
    used = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error')")
    rows = used.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), step.alias("f"))
    accesses = used.groupBy(F.col("user_id").alias("key")).agg(F.count_if(good).alias("accesses"))
    f = L.composed(rows).join(accesses, "key")
    return f.select("key", F.round(L.clamp_between(F.col("f.a") + F.col("f.b"), F.col("f.lo"), F.col("f.hi")), 6).alias("relevance"), "accesses")
