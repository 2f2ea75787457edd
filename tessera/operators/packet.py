"""From prompts to evidence packets: seeds, their surroundings, files under a budget, and what the packet claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import identifier_tokens
from tessera.operators.graph import attenuation, neighbour_views
from tessera.operators.select import coverage_claim, greedy_fill
from tessera.sources.scratch import cut
from tessera.sources.tables import spread


def seeds(prompts: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """prompts (task, prompt): the nodes that share most tokens with each, through an inverted index: (task, id, energy).

    Nodes that share the same tokens with all prompts have the same energies: the first of them by id stand for all, so that what
    meets the prompts is as many as the kinds, not as the nodes.
    """
    asked = prompts.select("task", F.array_distinct(F.filter(F.split(F.lower("prompt"), "[^a-z0-9]+"), lambda t: F.length(t) > 1)).alias("ts"))
    words = asked.select("task", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    index = spread(nodes.select("id", "name"), "id").select("id", F.explode(F.array_distinct(identifier_tokens(F.regexp_replace("name", "[ #]", "_")))).alias("token"))
    met = index.join(few(words.select("token").distinct()), "token", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("ts"))
    first = F.row_number().over(W.partitionBy("ts").orderBy("id"))
    kinds = cut(met.withColumn("place", first).filter(F.col("place") <= most).select("ts", "id"), "kinds")
    told = kinds.select("ts").distinct().select("ts", F.explode("ts").alias("token"))
    shares = words.join(told, "token").groupBy("task", "ts").agg((F.count(F.lit(1)) / F.max("n")).alias("energy"))
    place = F.row_number().over(W.partitionBy("task").orderBy(F.desc("energy"), "id"))
    return shares.join(kinds, "ts").withColumn("place", place).filter(F.col("place") <= most).select("task", "id", "energy")


def few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows that are counted, and broadcast if they are few."""
    held = cut(rows, "few")
    return F.broadcast(held) if held.count() <= most else held


def surroundings(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds and their neighbours, each with the most energy that reaches it: (task, id, energy)."""
    found = few(found)
    views = neighbour_views(edges).select("id", "neighbour", (F.col("weight") * attenuation()).alias("w"))
    near = views.join(found, "id").select("task", F.col("neighbour").alias("id"), (F.col("energy") * F.col("w")).alias("energy"))
    return found.unionByName(near).groupBy("task", "id").agg(F.max("energy").alias("energy"))


def files(reached: DataFrame, nodes: DataFrame, most: int = 40) -> DataFrame:
    """The best files of each task: (task, place, id, cost, score). A file costs its dearest symbol and scores its best one."""
    held = reached.join(nodes.select("id", "file_path", "token_cost"), "id")
    by = held.groupBy("task", F.col("file_path").alias("id")).agg(F.round(F.max("energy"), 6).alias("score"), F.max("token_cost").alias("cost"))
    place = F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "id"))
    return by.withColumn("place", place).filter(F.col("place") <= most)


def packets(prompts: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 200) -> DataFrame:
    """One row per prompt: task, seeds, candidates, files, tokens, claim."""
    found = cut(seeds(prompts, nodes), "seeds")
    ranked = cut(files(surroundings(found, edges), nodes), "ranked")
    taken = greedy_fill(ranked, budget).groupBy("task").agg(F.count(F.lit(1)).alias("files"), F.max("used").alias("tokens"))
    n = found.groupBy("task").agg(F.count(F.lit(1)).alias("seeds"))
    c = ranked.groupBy("task").agg(F.count(F.lit(1)).alias("candidates"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    out = prompts.select("task").join(n, "task", "left").join(c, "task", "left").join(taken, "task", "left").select("task", *map(zero, ("seeds", "candidates", "files", "tokens")))
    return out.withColumn("claim", coverage_claim(F.col("seeds"), F.lit(0), F.col("candidates") - F.col("files")))
