"""Learning state: clamped folds per key, spike timing, transitions, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW, HIGH = 0.05, 1.0


def clamp(x: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pheromone_fold(events: DataFrame, start: float = 0.5, block: int = 10_000) -> DataFrame:
    """events (key, ts, seq, kind): reinforce +0.15, penalise -0.10, evaporate x 0.98, clamped at every step, in order.

    A run of steps is a function x -> min(max(a x + b, low), high), and such functions compose to one of the same form.
    So a key's events are composed block by block, and blocks in order: no task ever holds more than a block.
    """
    a = F.when(F.col("kind") == "evaporate", 0.98).otherwise(1.0)
    b = F.when(F.col("kind") == "reinforce", 0.15).when(F.col("kind") == "penalise", -0.10).otherwise(0.0)
    step = F.struct(a.alias("a"), b.alias("b"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    f = composed(events.select("key", "ts", "seq", step.alias("f")), block)
    return f.select("key", F.round(clamp_between(F.col("f.a") * start + F.col("f.b"), F.col("f.lo"), F.col("f.hi")), 6).alias("weight"))


def composed(steps: DataFrame, block: int = 10_000) -> DataFrame:
    """steps (key, ts, seq, f): each key's steps in order as one function (key, f), composed in blocks of time of about so many."""
    ordered = steps.select("key", F.struct("ts", "seq").alias("at"), "f")
    sizes = ordered.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at.ts").alias("first"), F.max("at.ts").alias("last"))
    placed = ordered.join(sizes, "key").withColumn("span", F.greatest(F.lit(1.0), F.unix_micros("last") - F.unix_micros("first") + 1.0))
    placed = placed.withColumn("block", F.floor((F.unix_micros("at.ts") - F.unix_micros("first")) / F.col("span") * F.ceil(F.col("n") / block)).cast("long"))
    runs = placed.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("xs"))
    parts = runs.select("key", "block", fold_functions(F.transform("xs", lambda x: x["f"])).alias("f"))
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "f"))).alias("xs"))
    return whole.select("key", fold_functions(F.transform("xs", lambda x: x["f"])).alias("f"))


def clamp_between(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def fold_functions(steps: Column) -> Column:
    """Composes clamped linear functions in order: (a, b, lo, hi) stands for x -> clamp(a x + b, lo, hi), with a > 0."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e300).alias("lo"), F.lit(1e300).alias("hi"))

    def after(f: Column, g: Column) -> Column:
        low, high = g["a"] * f["lo"] + g["b"], g["a"] * f["hi"] + g["b"]
        return F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), clamp_between(low, g["lo"], g["hi"]).alias("lo"), clamp_between(high, g["lo"], g["hi"]).alias("hi"))

    return F.aggregate(steps, one, after)


def stdp(pairs: DataFrame, tau: float = 180.0) -> DataFrame:
    """pairs (id, dt seconds, useful): spikes before add 0.20 e^(-dt/tau), half as much again if useful; after take 0.15 e^(dt/tau)."""
    dt = F.col("dt")
    gain = F.when(dt >= 0, 0.20 * F.exp(-dt / tau) * F.when(F.col("useful"), 1.5).otherwise(1.0)).otherwise(-0.15 * F.exp(dt / tau))
    return pairs.groupBy("id").agg((F.round(F.sum(gain) + 1e-9, 6) + 0.0).alias("delta"))


def homeostasis(edges: DataFrame, cap: float = 3.5) -> DataFrame:
    """Weights into a node are scaled down together if they exceed the cap. Sums are aggregated before they are joined back."""
    sums = edges.groupBy("target").agg(F.sum("weight").alias("total"))
    scaled = F.when(F.col("total") > cap, F.col("weight") * cap / F.col("total")).otherwise(F.col("weight"))
    return edges.join(sums, "target").select("id", F.round(clamp(scaled) + 1e-9, 6).alias("weight"))


def transition_shares(moves: DataFrame) -> DataFrame:
    """moves (from, to): (from, to, n, p)."""
    counts = moves.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(W.partitionBy("from")), 6))


def predict_next(moves: DataFrame, k: int = 3, least: float = 0.15) -> DataFrame:
    shares = transition_shares(moves).filter(F.col("p") >= least)
    return shares.withColumn("place", F.row_number().over(W.partitionBy("from").orderBy(F.desc("p"), "to"))).filter(F.col("place") <= k).select("from", "place", "to", "p")


def multi_hop(moves: DataFrame, hops: int = 3, k: int = 5) -> DataFrame:
    """The most probable path to each other state within the hops, by product: (from, to, p)."""
    step = transition_shares(moves).select(F.col("from").alias("mid"), F.col("to").alias("next"), F.col("p").alias("q"))
    reached = step.select(F.col("mid").alias("from"), F.col("next").alias("to"), F.col("q").alias("p"))
    every = reached
    for _ in range(hops - 1):
        reached = reached.join(step, F.col("to") == F.col("mid")).select("from", F.col("next").alias("to"), (F.col("p") * F.col("q")).alias("p")).filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.max("p").alias("p"))
        every = every.unionByName(reached)
    best = every.groupBy("from", "to").agg(F.round(F.max("p"), 6).alias("p"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("from").orderBy(F.desc("p"), "to"))).filter(F.col("place") <= k).select("from", "place", "to", "p")


def decay_trails(trails: DataFrame, rounds: int) -> DataFrame:
    """trails (from, to, w): x 0.97 a round; those at 0.05 or less go."""
    return trails.withColumn("w", F.round(F.col("w") * 0.97**rounds, 6)).filter("w > 0.05")
