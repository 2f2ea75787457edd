"""Selection under a budget: scores, ranks, greedy fill, and an audit of what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recency(age_days: Column | str, half_life: float = 7.0) -> Column:
    """Halves every half life; from 0.2 to 1."""
    age = F.col(age_days) if isinstance(age_days, str) else age_days
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.exp(-age * F.log(F.lit(2.0)) / half_life)))


def relevance_score(relevance: Column, confidence: Column, impact: Column, age_days: Column, history: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), relevance * confidence * impact * recency(age_days) * history))


def unified_file_score(utility: Column, focus: Column, graph: Column, learned: Column, pheromone: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(64.0), utility + F.when(focus, 0.15 * utility).otherwise(0.0) + graph + learned + pheromone - penalty))


def seed_rank(seeds: DataFrame, most: int = 5, least: float = 0.3) -> DataFrame:
    """seeds (task, id, energy, pos): over the cap the strongest stay, at a floor, fading by place."""
    one = seeds.groupBy("task", "id").agg(F.max("energy").alias("energy"), F.min("pos").alias("pos"))
    ranked = one.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("task"))).withColumn("place", F.row_number().over(W.partitionBy("task").orderBy(F.desc("energy"), "pos", "id")))
    kept = ranked.filter((F.col("n") <= most) | ((F.col("place") <= most) & (F.col("energy") >= least)))
    faded = F.when(F.col("n") > most, F.col("energy") / (1 + 0.08 * (F.col("place") - 1))).otherwise(F.col("energy"))
    return kept.select("task", "id", "place", F.round(faded, 6).alias("energy"))


def diversified(candidates: DataFrame, per_package: int = 2, most: int = 6) -> DataFrame:
    """candidates (task, package, path, score): so many of a package, then so many in all."""
    inner = candidates.withColumn("k", F.row_number().over(W.partitionBy("task", "package").orderBy(F.desc("score"), "path"))).filter(F.col("k") <= per_package)
    return inner.withColumn("place", F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "path"))).filter(F.col("place") <= most).select("task", "place", "package", "path")


def greedy_fill(candidates: DataFrame, budget: int, most: int = 4096) -> DataFrame:
    """candidates (task, place, id, cost): in order of place, each that still fits is taken; one that doesn't is skipped.

    Costs are at least one token, so at most `budget` of a task can be taken; the fold over a task's candidates keeps
    only its running sum and the taken ids. Each task is a packet of bounded length: callers rank and cut first.
    """
    listed = candidates.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("place", "id", F.col("cost").cast("long").alias("cost")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(F.transform("xs", lambda x: x["id"]), 1, 0).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["taken"], F.array(x["id"])).alias("taken"))).otherwise(acc)

    return listed.select("task", F.aggregate("xs", start, step).alias("r")).select("task", F.col("r.used").alias("used"), F.explode("r.taken").alias("id"))


def unique_file_tokens(nodes: DataFrame) -> DataFrame:
    """A path costs what its file row costs, else its dearest symbol."""
    by = nodes.groupBy("file_path").agg(F.max(F.when(F.col("node_type") == "File", F.col("token_cost"))).alias("file"), F.max("token_cost").alias("symbol"))
    return by.agg(F.sum(F.coalesce("file", "symbol")).alias("tokens"), F.count(F.lit(1)).alias("files"))


def drop_stage(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that drops a row, or `kept`."""
    out = F.lit("kept")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def coverage_claim(seeds: Column, missing: Column, gaps: Column) -> Column:
    return F.when(seeds == 0, "no_seed_resolved").when(missing > 0, "partial").when(gaps > 0, "bounded").otherwise("no_recorded_gap")


def promoted(candidates: DataFrame, most: int, least_bonus: float, margin: float) -> DataFrame:
    """candidates (task, id, score, bonus): the best by score; the last of them gives way to the best learned one beyond,
    if that has enough bonus and, with it, beats the last by the margin. (task, id, why)"""
    ranked = candidates.withColumn("place", F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "id")))
    weakest = F.min(F.when(F.col("place") <= most, F.col("score")))
    beyond = (F.col("place") > most) & (F.col("bonus") >= least_bonus)
    lifted = F.when(beyond, F.struct((F.col("score") + F.col("bonus")).alias("lifted"), (-F.col("id")).alias("order"), F.col("id").alias("id")))
    by = ranked.groupBy("task").agg(weakest.alias("least"), F.max(lifted).alias("best")).filter(F.col("best.lifted") > F.col("least") + margin).select("task", F.col("best.id").alias("new"))
    kept = ranked.filter(F.col("place") <= most).join(by, "task", "left").filter((F.col("place") < most) | F.col("new").isNull())
    return kept.select("task", "id", F.lit("ranked").alias("why")).unionByName(by.select("task", F.col("new").alias("id"), F.lit("learned").alias("why")))
