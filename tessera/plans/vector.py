"""Queries of vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import vector as V
from tessera.sources.tables import vectors

D = "CAST({} AS DOUBLE[])"
DOT = f"list_inner_product({D.format('a.embedding')}, {D.format('b.embedding')})"
TOP_SQL = "SELECT q, place, node_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id) AS INT) AS place FROM scored) WHERE place <= {}"


def asked(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """The query set of searches: rows whose id is divisible by 20."""
    return vectors(spark, sf_dir).filter(F.col("node_id") % every == 0).select(F.col("node_id").alias("q"), F.col("v").alias("x"), F.col("dir").alias("q_dir"))


@query(f"WITH scored AS (SELECT a.vec_id AS q, b.vec_id AS node_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) " + TOP_SQL.format(16).replace("FROM scored", "FROM scored WHERE score >= 0.05"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(vectors(spark, sf_dir), asked(spark, sf_dir, 20).select("q", "x"), 16, 0.05)


@query(f"WITH scored AS (SELECT a.vec_id AS q, b.vec_id AS node_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label IN (1, 3)) " + TOP_SQL.format(8))
def vector_topk_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(vectors(spark, sf_dir).filter("dir IN (1, 3)"), asked(spark, sf_dir, 20).select("q", "x"), 8)


@query(f"WITH pool AS (SELECT * FROM embeddings WHERE label = 2), chosen AS (SELECT * FROM embeddings WHERE (SELECT count(*) FROM pool) < greatest(64, (SELECT count(*) FROM embeddings) / 20) OR label = 2), scored AS (SELECT a.vec_id AS q, b.vec_id AS node_id, round({DOT}, 6) AS score FROM embeddings a, chosen b WHERE a.vec_id % 20 = 0) " + TOP_SQL.format(8))
def vector_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate pool if it is large enough, else all."""
    every = vectors(spark, sf_dir)
    pool = every.filter("dir = 2")
    enough = pool.count() >= max(64, every.count() / 20)
    return V.top_k(pool if enough else every, asked(spark, sf_dir, 20).select("q", "x"), 8)


CENTROID_SQL = """parts AS (SELECT label AS dir, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
means AS (SELECT dir, max(n) AS n, list(m ORDER BY i) AS c FROM parts GROUP BY dir HAVING max(n) >= 2), centroids AS (SELECT dir, n, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM means)"""


@query(f"WITH {CENTROID_SQL} SELECT dir, CAST(n AS BIGINT) AS n, round(c[1], 6) AS first, round(list_sum(list_transform(c, lambda x: abs(x))), 6) AS total FROM centroids")
def module_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return V.centroids(vectors(spark, sf_dir)).select("dir", "n", F.round(F.col("c")[0], 6).alias("first"), F.round(total, 6).alias("total"))


@query(f"WITH {CENTROID_SQL} SELECT vec_id AS node_id, round(greatest(0.0, 0.05 * max(list_inner_product(CAST(embedding AS DOUBLE[]), c))), 6) AS bonus FROM embeddings, centroids GROUP BY vec_id")
def module_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 0.05 of the largest cosine with a directory's centroid."""
    v = vectors(spark, sf_dir)
    near = v.select("node_id", "v").join(F.broadcast(V.centroids(v).select("c")))
    return near.groupBy("node_id").agg(F.round(F.greatest(F.lit(0.0), 0.05 * F.max(V.dot("v", "c"))), 6).alias("bonus"))


@query(f"""WITH {CENTROID_SQL}, files AS (SELECT a.vec_id AS q, dir, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), c), 9) DESC, dir) AS r FROM embeddings a, centroids WHERE a.vec_id % 20 = 0),
scored AS (SELECT f.q, b.vec_id AS node_id, round({DOT}, 6) AS score FROM files f JOIN embeddings a ON a.vec_id = f.q JOIN embeddings b ON b.label = f.dir WHERE r <= 2) """ + TOP_SQL.format(8))
def vector_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest directories first, then their symbols."""
    v = vectors(spark, sf_dir)
    near = asked(spark, sf_dir, 20).join(F.broadcast(V.centroids(v).select("dir", "c"))).select("q", "x", "dir", F.round(V.dot("x", "c"), 9).alias("s"))
    chosen = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "dir"))).filter("r <= 2").select("q", "x", "dir")
    return V.top_k(v, chosen, 8, on="dir")


@query(f"WITH scored AS (SELECT a.vec_id AS q, b.vec_id AS node_id, round({DOT} * CASE WHEN b.label = 0 THEN 0.55 WHEN b.label = 1 THEN 1.12 ELSE 1.0 END * CASE WHEN b.vec_id % 7 = 0 THEN 1.15 ELSE 1.0 END, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) " + TOP_SQL.format(4).replace("FROM scored", "FROM scored WHERE score >= 0.1"))
def file_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise loses, libraries and files of the same stem gain; the threshold holds after that."""
    factor = F.when(F.col("dir") == 0, 0.55).when(F.col("dir") == 1, 1.12).otherwise(1.0) * F.when(F.col("node_id") % 7 == 0, 1.15).otherwise(1.0)
    return V.top_k(vectors(spark, sf_dir).withColumn("factor", factor), asked(spark, sf_dir, 20).select("q", "x"), 4, 0.1)


@query("WITH s AS (SELECT vec_id AS node_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings) SELECT node_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) AS total FROM s")
def normalize_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = vectors(spark, sf_dir).select("node_id", V.normalized("v", 16).alias("v"))
    return cut.select("node_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH s AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS scale FROM embeddings) SELECT node_id, round(scale, 6) AS scale, CAST(list_sum(list_transform(v, lambda x: CAST(round(x / scale * 127) AS INT))) AS BIGINT) AS total FROM s")
def quantize_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).select("node_id", V.quantized("v").alias("x"))
    return q.select("node_id", F.round("x.scale", 6).alias("scale"), F.aggregate("x.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH s AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS scale FROM embeddings), z AS (SELECT node_id, v, scale, list_transform(v, lambda x: round(x / scale * 127)) AS z FROM s),
scored AS (SELECT a.node_id AS q, b.node_id, round(list_inner_product(a.v, b.z) * b.scale / 127, 6) AS score FROM z a, z b WHERE a.node_id % 20 = 0) """ + TOP_SQL.format(8))
def quantized_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = vectors(spark, sf_dir).select("node_id", V.quantized("v").alias("z")).select("node_id", F.col("z.q").alias("v"), (F.col("z.scale") / 127).alias("factor"))
    return V.top_k(held, asked(spark, sf_dir, 20).select("q", "x"), 8)


CORR_SQL = "p AS (SELECT a.vec_id AS q, b.vec_id AS node_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x, list_inner_product(CAST(a.embedding[1:32] AS DOUBLE[]), CAST(b.embedding[1:32] AS DOUBLE[])) AS y FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@query(f"WITH {CORR_SQL} SELECT q, round(corr(x, y), 6) AS pearson FROM p GROUP BY q")
def pearson_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pearson(vectors(spark, sf_dir), asked(spark, sf_dir, 20), 32)


@query(f"WITH {CORR_SQL}, r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(x, 9), node_id) AS rx, row_number() OVER (PARTITION BY q ORDER BY round(y, 9), node_id) AS ry FROM p) SELECT q, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY q")
def spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are ordinal: ties go by id and aren't averaged."""
    return V.spearman(vectors(spark, sf_dir), asked(spark, sf_dir, 20), 32)


@query()
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leader clustering within each packet: a label's vectors of 40 ids, in order of id."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf.node_id, pdf.v, strict=True))
        return pd.DataFrame(V.greedy_dedup(rows, 0.5), columns=["node_id", "leader"])

    packets = vectors(spark, sf_dir).withColumn("packet", F.expr("node_id div 40"))
    return packets.groupBy("dir", "packet").applyInPandas(run, "node_id long, leader long")


@query("""WITH c AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 16), s AS (SELECT a.vec_id AS q, c.vec_id AS hit, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), c.v), 6) AS score FROM embeddings a JOIN c ON a.label = c.label)
SELECT q, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, hit) AS r FROM s WHERE score >= 0.3) WHERE r = 1""")
def semantic_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of sixteen cached vectors under the same key, if near enough."""
    cached = vectors(spark, sf_dir).filter("node_id < 16").select("dir", F.col("node_id").alias("hit"), F.col("v").alias("c"))
    scored = vectors(spark, sf_dir).join(F.broadcast(cached), "dir").select(F.col("node_id").alias("q"), "hit", F.round(V.dot("v", "c"), 6).alias("score")).filter("score >= 0.3")
    return scored.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "hit"))).filter("r = 1").select("q", "hit", "score")


@query(f"WITH {CENTROID_SQL}, s AS (SELECT vec_id AS q, dir, round(list_inner_product(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings, centroids) SELECT q, dir AS intent, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, dir) AS r FROM s WHERE score >= 0.1) WHERE r = 1")
def query_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest prototype, if near enough."""
    v = vectors(spark, sf_dir)
    scored = v.select(F.col("node_id").alias("q"), "v").join(F.broadcast(V.centroids(v).select("dir", "c"))).select("q", "dir", F.round(V.dot("v", "c"), 6).alias("score")).filter("score >= 0.1")
    return scored.groupBy("q").agg(F.max_by(F.struct("dir", "score"), F.struct("score", -F.col("dir"))).alias("x")).select("q", F.col("x.dir").alias("intent"), "x.score")
