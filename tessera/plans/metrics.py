"""Queries of aggregations and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import metrics as M
from tessera.operators.vector import nearest
from tessera.sources.tables import table

TELEMETRY_SQL = """telemetry AS (SELECT event_id AS request_id, 'p' || (user_id % 10) AS project_id, CAST(round(value * 100) AS BIGINT) AS tokens_before, CAST(round(value * CASE WHEN event_type = 'purchase' THEN 120 ELSE 40 END) AS BIGINT) AS tokens_after, event_type = 'view' AS cache_hit, round(value * 3, 2) AS latency_ms, ts FROM events)"""
SUMMARY_SQL = """count(*) AS requests, CAST(sum(tokens_before) AS BIGINT) AS before, CAST(sum(tokens_after) AS BIGINT) AS after, CAST(sum(greatest(tokens_before - tokens_after, 0)) AS BIGINT) AS saved,
round(100.0 * sum(greatest(tokens_before - tokens_after, 0)) / sum(tokens_before), 6) AS saved_pct, round(avg(CASE WHEN tokens_after < tokens_before THEN 100.0 * (tokens_before - tokens_after) / tokens_before END), 6) AS mean_pct,
round(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(latency_ms), 6) AS latency_ms"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("event_type") == "purchase", 120).otherwise(40)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project_id"), F.round(F.col("value") * 100).cast("long").alias("tokens_before"),
        F.round(F.col("value") * factor).cast("long").alias("tokens_after"), (F.col("event_type") == "view").alias("cache_hit"), F.round(F.col("value") * 3, 2).alias("latency_ms"), "ts",
    )


@query(f"WITH {TELEMETRY_SQL} SELECT {SUMMARY_SQL} FROM telemetry")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.telemetry_summary(telemetry(spark, sf_dir))


@query(f"WITH {TELEMETRY_SQL} SELECT project_id, {SUMMARY_SQL} FROM telemetry GROUP BY project_id")
def telemetry_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.telemetry_summary(telemetry(spark, sf_dir), "project_id")


@query(f"WITH {TELEMETRY_SQL}, twice AS (SELECT *, 0 AS k FROM telemetry UNION ALL SELECT *, 1 FROM telemetry WHERE request_id % 3 = 0), d AS (SELECT request_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts) AS r FROM twice) WHERE r = 1) SELECT request_id, ts FROM d ORDER BY ts DESC, request_id LIMIT 1000")
def telemetry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thousand requests; a request that is told twice counts once."""
    rows = telemetry(spark, sf_dir).select("request_id", "ts")
    twice = rows.unionByName(rows.filter("request_id % 3 = 0"))
    return twice.groupBy("request_id").agg(F.min("ts").alias("ts")).orderBy(F.desc("ts"), "request_id").limit(1000)


@query("WITH c AS (SELECT user_id, event_type AS k, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), now AS (SELECT max(ts) AS newest FROM events) SELECT user_id, k, ts FROM c, now WHERE r = 1 AND ts > newest - INTERVAL 2 DAY")
def ttl_cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key that isn't past its life; now is the newest event."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id", F.col("event_type").alias("k")).agg(F.max("ts").alias("ts"))
    return last.crossJoin(F.broadcast(events.agg(F.max("ts").alias("newest")))).filter("ts > newest - INTERVAL 2 DAYS").select("user_id", "k", "ts")


CELLS_SQL = """cells AS (SELECT d.doc_id AS cell_id, d.lang AS benchmark, least(1.0, n_chars / 4000.0) AS predicted, CAST(quality AS DOUBLE) AS outcome, toxic = 1 AS failed, n_chars AS tokens, least(1.0, (n_chars % 100) / 80.0) AS recall, greatest(0.1, (n_chars % 37) / 37.0) AS precision_, (n_chars % 90) + 1.0 AS l1_ms FROM documents d JOIN labels USING (doc_id))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return joined.select(
        F.col("doc_id").alias("cell_id"), F.col("lang").alias("benchmark"), F.least(F.lit(1.0), n / 4000.0).alias("predicted"), F.col("quality").cast("double").alias("outcome"), (F.col("toxic") == 1).alias("failed"),
        n.alias("tokens"), F.least(F.lit(1.0), n % 100 / 80.0).alias("recall"), F.greatest(F.lit(0.1), n % 37 / 37.0).alias("precision_"), (n % 90 + 1.0).cast("double").alias("l1_ms"),
    )


@query(f"""WITH {CELLS_SQL} SELECT benchmark, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision_), 6) AS precision_, round(CASE WHEN avg(recall) + avg(precision_) > 0 THEN 2 * avg(recall) * avg(precision_) / (avg(recall) + avg(precision_)) ELSE 0 END, 6) AS f1,
round(avg(outcome), 6) AS success_rate, round(1000 * sum(outcome) / sum(tokens), 6) AS per_1k_tokens, round(100 * sum(outcome) / sum(l1_ms), 6) AS per_100ms FROM cells GROUP BY benchmark""")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_metrics(cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT benchmark, percentile_disc(0.5) WITHIN GROUP (ORDER BY l1_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l1_ms) AS p95 FROM cells GROUP BY benchmark")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("benchmark").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l1_ms)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l1_ms)").alias("p95"))


PARETO_SQL = f"""WITH {CELLS_SQL}, g AS (SELECT tokens // 500 AS method, avg(outcome) AS success, avg(tokens) AS tokens FROM cells GROUP BY 1),
r AS (SELECT *, min(tokens) OVER (ORDER BY success DESC, tokens, method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g) SELECT method, round(success, 6) AS success, round(tokens, 6) AS tokens FROM r WHERE best IS NULL OR tokens <= best"""


@query(PARETO_SQL)
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cells(spark, sf_dir).groupBy(F.expr("tokens div 500").alias("method")).agg(F.avg("outcome").alias("success"), F.avg("tokens").alias("tokens"))
    return M.pareto(groups).select("method", F.round("success", 6).alias("success"), F.round("tokens", 6).alias("tokens"))


@query(f"""WITH {CELLS_SQL} SELECT avg(recall) >= 0.55 AS recall_ok, avg(precision_) >= 0.73 AS precision_ok, sum(CASE WHEN failed THEN 1 ELSE 0 END) <= 2 AS failures_ok, percentile_disc(0.95) WITHIN GROUP (ORDER BY l1_ms) <= 50 AS latency_ok,
avg(recall) >= 0.55 AND avg(precision_) >= 0.73 AND sum(CASE WHEN failed THEN 1 ELSE 0 END) <= 2 AND percentile_disc(0.95) WITHIN GROUP (ORDER BY l1_ms) <= 50 AS passed FROM cells""")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.release_gates(cells(spark, sf_dir))


@query(f"""WITH {CELLS_SQL} SELECT CASE WHEN outcome = 1 THEN 'none' WHEN failed THEN 'unsafe' WHEN recall = 0 THEN 'no_seed' WHEN recall < 0.5 THEN 'low_recall' WHEN precision_ < 0.4 THEN 'low_precision' WHEN l1_ms > 50 THEN 'slow' ELSE 'other' END AS failure_class, count(*) AS n FROM cells GROUP BY 1""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy(M.failure_class().alias("failure_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELLS_SQL} SELECT benchmark, CASE WHEN pct < 40 THEN 'train' WHEN pct < 60 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT benchmark, (row_number() OVER (PARTITION BY benchmark ORDER BY cell_id) - 1) * 100 // count(*) OVER (PARTITION BY benchmark) AS pct FROM cells) GROUP BY 1, 2""")
def data_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.data_split(cells(spark, sf_dir), "benchmark", "cell_id").groupBy("benchmark", "split").agg(F.count(F.lit(1)).alias("n"))


RANKED_SQL = """ranked AS (SELECT a.vec_id AS q, a.label AS gold, b.label AS got, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS place
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), top AS (SELECT * FROM ranked WHERE place <= 10), golds AS (SELECT q.vec_id AS q, count(*) AS n FROM embeddings q JOIN embeddings o ON o.label = q.label AND o.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of the query set (id divisible by 20) its ten nearest, relevant where the label is the same: (q, gold, got, place)."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("gold"), F.col("embedding").alias("x"))
    rows = v.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("node_id"), F.col("label").alias("got"), F.col("embedding").alias("v"))
    return nearest(rows, asked, 10, digits=9, apart=True).select("q", "gold", "got", "place")


def gold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label").join(v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")), "label").select("q", "n")


@query(f"WITH {RANKED_SQL} SELECT round(avg(rr), 6) AS mrr FROM (SELECT q, coalesce(max(CASE WHEN gold = got THEN 1.0 / place END), 0.0) AS rr FROM top GROUP BY q)")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mrr(ranked(spark, sf_dir).withColumn("hit", F.col("gold") == F.col("got")))


@query(f"""WITH {RANKED_SQL}, d AS (SELECT q, sum(CASE WHEN gold = got THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM top GROUP BY q)
SELECT q, round(CASE WHEN n = 0 THEN 1.0 ELSE dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM d JOIN golds USING (q)""")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ndcg(ranked(spark, sf_dir).withColumn("hit", F.col("gold") == F.col("got")), gold_sizes(spark, sf_dir), 10)


@query(f"""WITH {RANKED_SQL} SELECT q, round(CASE WHEN any_value(n) = 0 THEN 1.0 ELSE least(1.0, count(*) FILTER (WHERE gold = got) / any_value(n)) END, 6) AS recall, round(count(*) FILTER (WHERE gold = got) / least(10, count(*)), 6) AS precision_ FROM top JOIN golds USING (q) GROUP BY q""")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.precision_recall(ranked(spark, sf_dir).withColumn("hit", F.col("gold") == F.col("got")), gold_sizes(spark, sf_dir), 10)


@query(f"""WITH {RANKED_SQL}, e AS (SELECT q, CASE WHEN any_value(n) = 0 THEN 1.0 ELSE least(1.0, count(*) FILTER (WHERE gold = got) / any_value(n)) END AS recall, CASE WHEN bool_or(got = 0) THEN 0.0 ELSE count(*) FILTER (WHERE gold = got) / count(*) END AS precision_ FROM top JOIN golds USING (q) GROUP BY q)
SELECT q, round(recall, 6) AS recall, round(precision_, 6) AS precision_, recall < 0.8 OR precision_ < 0.4 AS grep_needed FROM e""")
def gold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of a task; a forbidden result makes precision 0."""
    hits = ranked(spark, sf_dir).withColumn("hit", F.col("gold") == F.col("got")).withColumn("forbidden", F.col("got") == 0)
    return M.gold_eval(hits, gold_sizes(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT round(coalesce(avg(power(predicted - outcome, 2)), 1.0), 6) AS brier, count(*) AS n FROM cells")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.brier(cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT round(CASE WHEN count(*) = 0 THEN NULL WHEN count(*) FILTER (WHERE predicted >= 0.7) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE predicted >= 0.7 AND outcome = 0) / count(*) FILTER (WHERE predicted >= 0.7) END, 6) AS fsr, round(count(*) FILTER (WHERE predicted < 0.7 AND outcome = 1) / count(*), 6) AS false_insufficiency FROM cells")
def fsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.false_sufficiency(cells(spark, sf_dir), 0.7)


GRID_SQL = f"""WITH {CELLS_SQL}, grid AS (SELECT CAST(i AS INT) AS step, 0.55 + i * 0.02 AS t FROM range(0, 18) r(i)), s AS (SELECT step, t, count(*) FILTER (WHERE predicted >= t AND outcome = 0) AS wrong, count(*) FILTER (WHERE predicted >= t) AS claimed, count(*) FILTER (WHERE predicted < t AND outcome = 1) AS missed, count(*) AS n FROM grid, cells GROUP BY step, t)
SELECT step, round(t, 6) AS threshold, round(CASE WHEN claimed = 0 THEN 0.0 ELSE wrong / claimed END + missed / n, 6) AS proxy FROM s"""


@query(GRID_SQL)
def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_grid(cells(spark, sf_dir))


@query(GRID_SQL.replace("SELECT step, round(t", "SELECT step, threshold, proxy FROM (SELECT step, round(t") + ") ORDER BY proxy, step LIMIT 1")
def calibrated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first threshold with the least proxy."""
    return M.calibration_grid(cells(spark, sf_dir)).orderBy("proxy", "step").limit(1)


@query("""WITH f AS (SELECT doc_id, lang, source FROM documents), g AS (SELECT lang, source, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT lang, sum(n) AS n, sum(n * (n - 1)) / 2 AS same FROM g GROUP BY lang)
SELECT lang, round(CASE WHEN n < 2 THEN 1.0 ELSE same / (n * (n - 1) / 2) END, 6) AS coherence FROM l""")
def pairwise_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pairs of a packet's files with the same first segment, from counts: no pairs are made."""
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("packet"), F.col("source").alias("segment"))
    return M.coherence(files).withColumnRenamed("packet", "lang")


@query("""SELECT event_type, round(least(1.0, greatest(0.0, 0.45 * avg(value) / 100 + 0.30 * count(DISTINCT user_id) / 1000 + 0.25 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * (1.1 - 0.2 * 0.82)), 6) AS gate FROM events GROUP BY event_type""")
def osmotic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = 0.45 * F.avg("value") / 100 + 0.30 * F.count_distinct("user_id") / 1000 + 0.25 * F.when(F.col("event_type") == "error", 1).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw) * (1.1 - 0.2 * 0.82)), 6).alias("gate"))


@query("""SELECT conv_id, CAST(greatest(2048, CAST(floor(0.40 * sum(length(text))) AS BIGINT)) AS BIGINT) AS context_budget, CAST(greatest(1024, CAST(floor(0.25 * sum(length(text))) AS BIGINT)) AS BIGINT) AS answer_budget FROM conversations GROUP BY conv_id""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.length("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.greatest(F.lit(2048), F.floor(0.40 * total)).cast("long").alias("context_budget"), F.greatest(F.lit(1024), F.floor(0.25 * total)).cast("long").alias("answer_budget")
    )


@query(f"WITH {CELLS_SQL} SELECT benchmark, round(CASE WHEN count(*) FILTER (WHERE predicted >= 0.7) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE predicted >= 0.7 AND (failed OR recall < 0.5)) / count(*) FILTER (WHERE predicted >= 0.7) END, 6) AS proxy FROM cells GROUP BY benchmark")
def fsr_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without labels: of what was claimed, the share with a gap on record."""
    claimed = F.count_if(F.col("predicted") >= 0.7)
    gaps = F.count_if((F.col("predicted") >= 0.7) & (F.col("failed") | (F.col("recall") < 0.5)))
    return cells(spark, sf_dir).groupBy("benchmark").agg(F.round(F.when(claimed == 0, 0.0).otherwise(F.try_divide(gaps, claimed)), 6).alias("proxy"))
