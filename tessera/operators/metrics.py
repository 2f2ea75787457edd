"""Aggregations: telemetry, benchmark cells, ranking quality, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def telemetry_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Totals; savings never count below 0; the mean share is over requests that saved something."""
    before, after = F.col("tokens_before"), F.col("tokens_after")
    saved = F.sum(F.greatest(before - after, F.lit(0)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(before).alias("before"), F.sum(after).alias("after"), saved.alias("saved"),
        F.round(100.0 * saved / F.sum(before), 6).alias("saved_pct"), F.round(F.avg(F.when(after < before, 100.0 * (before - after) / before)), 6).alias("mean_pct"),
        F.round(F.avg(F.when(F.col("cache_hit"), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"),
    )


def cell_metrics(cells: DataFrame) -> DataFrame:
    r, p = F.avg("recall"), F.avg("precision_")
    return cells.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision_"), F.round(F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0), 6).alias("f1"),
        F.round(F.avg("outcome"), 6).alias("success_rate"), F.round(1000 * F.sum("outcome") / F.sum("tokens"), 6).alias("per_1k_tokens"), F.round(100 * F.sum("outcome") / F.sum("l1_ms"), 6).alias("per_100ms"),
    )


def pareto(groups: DataFrame) -> DataFrame:
    """Best success first: those with no more tokens than any before. Groups are few: methods, not cells."""
    before = W.orderBy(F.desc("success"), "tokens", "method").rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("best", F.min("tokens").over(before)).filter("best IS NULL OR tokens <= best").drop("best")


def release_gates(cells: DataFrame) -> DataFrame:
    gates = cells.agg(
        (F.avg("recall") >= 0.55).alias("recall_ok"), (F.avg("precision_") >= 0.73).alias("precision_ok"), (F.count_if(F.col("failed")) <= 2).alias("failures_ok"), (F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l1_ms)") <= 50).alias("latency_ok")
    )
    return gates.withColumn("passed", F.expr("recall_ok AND precision_ok AND failures_ok AND latency_ok"))


def failure_class() -> Column:
    return (
        F.when(F.col("outcome") == 1, "none").when(F.col("failed"), "unsafe").when(F.col("recall") == 0, "no_seed").when(F.col("recall") < 0.5, "low_recall")
        .when(F.col("precision_") < 0.4, "low_precision").when(F.col("l1_ms") > 50, "slow").otherwise("other")
    )


def data_split(rows: DataFrame, group: str, key: str) -> DataFrame:
    """By place in the group: 40 % train, 20 % validation, 40 % test."""
    pct = F.expr(f"(row_number() OVER (PARTITION BY {group} ORDER BY {key}) - 1) * 100 div count(*) OVER (PARTITION BY {group})")
    return rows.withColumn("split", F.when(pct < 40, "train").when(pct < 60, "validation").otherwise("test"))


def mrr(ranked: DataFrame) -> DataFrame:
    """ranked (q, place, hit): the mean of 1 / place of the first hit, 0 without one."""
    first = ranked.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("hit"), 1.0 / F.col("place"))), F.lit(0.0)).alias("rr"))
    return first.agg(F.round(F.avg("rr"), 6).alias("mrr"))


def ndcg(ranked: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    dcg = ranked.groupBy("q").agg(F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return dcg.join(golds, "q").select("q", F.round(F.when(F.col("n") == 0, 1.0).otherwise(F.col("dcg") / best), 6).alias("ndcg"))


def precision_recall(ranked: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    hits = ranked.groupBy("q").agg(F.count_if(F.col("hit")).alias("h"), F.count(F.lit(1)).alias("m")).join(golds, "q")
    recall = F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("h") / F.col("n")))
    return hits.select("q", F.round(recall, 6).alias("recall"), F.round(F.col("h") / F.least(F.lit(k), F.col("m")), 6).alias("precision_"))


def gold_eval(ranked: DataFrame, golds: DataFrame) -> DataFrame:
    hits = ranked.groupBy("q").agg(F.count_if(F.col("hit")).alias("h"), F.count(F.lit(1)).alias("m"), F.max("forbidden").alias("bad")).join(golds, "q")
    recall = F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("h") / F.col("n")))
    precision = F.when(F.col("bad"), 0.0).otherwise(F.col("h") / F.col("m"))
    return hits.select("q", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision_"), ((recall < 0.8) | (precision < 0.4)).alias("grep_needed"))


def brier(cells: DataFrame) -> DataFrame:
    """Mean squared error; 1 without cells."""
    return cells.agg(F.round(F.coalesce(F.avg(F.pow(F.col("predicted") - F.col("outcome"), F.lit(2.0))), F.lit(1.0)), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


def false_sufficiency(cells: DataFrame, threshold: float) -> DataFrame:
    """Of what was claimed, the share that failed: null without cells, 0 without claims."""
    claimed, n = F.count_if(F.col("predicted") >= threshold), F.count(F.lit(1))
    wrong = F.count_if((F.col("predicted") >= threshold) & (F.col("outcome") == 0))
    missed = F.count_if((F.col("predicted") < threshold) & (F.col("outcome") == 1))
    rate = F.when(n == 0, None).when(claimed == 0, 0.0).otherwise(F.try_divide(wrong, claimed))
    return cells.agg(F.round(rate, 6).alias("fsr"), F.round(F.try_divide(missed, n), 6).alias("false_insufficiency"))


def calibration_grid(cells: DataFrame, first: float = 0.55, step: float = 0.02, steps: int = 18) -> DataFrame:
    """The error proxy at each threshold. One pass: each cell counts at the grid step up to which it is claimed."""
    at = cells.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "predicted", "outcome").withColumn("t", F.lit(first) + F.col("step") * step)
    claimed = F.count_if(F.col("predicted") >= F.col("t"))
    wrong = F.count_if((F.col("predicted") >= F.col("t")) & (F.col("outcome") == 0))
    missed = F.count_if((F.col("predicted") < F.col("t")) & (F.col("outcome") == 1))
    proxy = F.when(claimed == 0, 0.0).otherwise(F.try_divide(wrong, claimed)) + missed / F.count(F.lit(1))
    return at.groupBy("step", "t").agg(F.round(proxy, 6).alias("proxy")).select("step", F.round("t", 6).alias("threshold"), "proxy")


def coherence(files: DataFrame) -> DataFrame:
    """files (packet, segment): share of pairs with one segment, 1 where there is no pair."""
    counts = files.groupBy("packet", "segment").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("packet").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    return by.select("packet", F.round(F.when(F.col("n") < 2, 1.0).otherwise(F.col("same") / (F.col("n") * (F.col("n") - 1) / 2)), 6).alias("coherence"))
