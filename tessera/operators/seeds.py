"""Seeds of a task: what its prompt and its client name, asked for in stages and resolved to nodes.

Tasks are rows with a signature (`tasks.signature`) and the client's arrays keywords, expansion, path_hints and entity_types. A
strategy is a list of steps, each of stages; a step counts only for tasks that no step before it gave a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.anchors import FILLER_WORDS, STOP_WORDS
from tessera.functions.prompts import prompt_tokens
from tessera.operators.search import resolve_unique

# Energies and bounds.
IDENTIFIER, FILE, CONCEPT, CODE_CONCEPT, TOKEN, FALLBACK = 1.0, 0.95, 0.82, 0.88, 0.55, 0.5
KEYWORD, EXPANSION, PATH_HINT, ENTITY_TYPE, DECAY, LEAST = 0.8, 0.5, 0.3, 0.2, 0.08, 0.3
MOST_KEYWORDS, MOST_EXPANSION, MOST_TOKENS, MOST_SEEDS = 8, 8, 8, 5
SHAPES = ("layout", "breakpoints", "state")
STRATEGIES = {
    "off": (("anchors",),), "keywords": (("anchors", "keywords"),), "keywords_expanded": (("anchors", "keywords", "expansion", "hints"),), "semantic_lite": (("anchors",), ("tokens",), ("keywords", "expansion", "hints")),
    "hybrid": (("anchors", "keywords", "expansion", "hints"), ("tokens",)),
}


def asks(words: Column, energy: Column | float, reason: str, decays: bool = False) -> Column:
    """An array of (query, energy, reason); later ones of a client's list weigh less."""
    weigh = lambda i: F.lit(energy) / (1 + i * DECAY) if decays else F.lit(energy)
    return F.transform(words, lambda w, i: F.struct(w.alias("query"), weigh(i).cast("double").alias("energy"), F.lit(reason).alias("reason")))


def alike(words: str, x: Column) -> Column:
    return F.exists(words, lambda y: F.lower(y) == F.lower(x))


def clean(words: Column, least: int) -> Column:
    """Words without punctuation at their edges, of so many bytes, that say something."""
    edge = r"[^\p{L}\p{N}_]+"
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", "")), lambda w: (F.octet_length(w) >= least) & ~F.lower(w).isin(*STOP_WORDS, *FILLER_WORDS))


def stage(name: str, prompt: str = "prompt") -> Column:
    """What a stage asks for, in order."""
    if name == "anchors":
        named = F.filter("identifiers", lambda x: F.lower(x) != F.lower("technology"))
        entity = F.when((F.col("entity") != "Workspace") & ~F.array_contains("identifiers", F.col("entity")) & (F.col("intent") != "create"), F.array("entity")).otherwise(F.array().cast("array<string>"))
        is_code = lambda x: F.contains(x, F.lit(".")) | F.contains(x, F.lit("("))
        own = F.filter("concepts", lambda x: (is_code(x) | (F.octet_length(x) >= 4)) & ~alike("identifiers", x) & ~F.lower(x).isin(*SHAPES) & (F.lower(x) != F.lower("technology")))
        concepts = F.transform(own, lambda x: F.struct(x.alias("query"), F.when(is_code(x), CODE_CONCEPT).otherwise(CONCEPT).alias("energy"), F.when(is_code(x), "alias_code").otherwise("concept").alias("reason")))
        return F.concat(asks(named, IDENTIFIER, "identifier"), asks(entity, IDENTIFIER, "entity"), asks(F.col("files"), FILE, "file"), concepts)
    if name == "tokens":
        return asks(clean(F.slice(F.split(F.trim(prompt), r"\s+"), 1, MOST_TOKENS), 5), TOKEN, "token")
    if name == "fallback":
        return asks(clean(prompt_tokens(F.col(prompt)), 3), FALLBACK, "fallback")
    if name == "keywords":
        return asks(F.slice("keywords", 1, MOST_KEYWORDS), KEYWORD, "client_keyword", True)
    if name == "expansion":
        return asks(F.slice("expansion", 1, MOST_EXPANSION), EXPANSION, "client_expansion", True)
    return F.concat(asks(F.col("path_hints"), PATH_HINT, "path_hint", True), asks(F.col("entity_types"), ENTITY_TYPE, "entity_type", True))


def asked(tasks: DataFrame, steps: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(task, query, energy, reason, step, place): each query of a task once, as it was asked first."""
    def numbered(step: int, stages: tuple[str, ...]) -> Column:
        return F.transform(F.concat(*map(stage, stages)), lambda x, i: F.struct(F.lit(step).alias("step"), i.alias("place"), x["query"].alias("query"), x["energy"].alias("energy"), x["reason"].alias("reason")))

    told = F.concat(*[numbered(i, stages) for i, stages in enumerate(steps)])
    every = tasks.select("task", F.explode(told).alias("x")).select("task", "x.*")
    order = F.struct("step", "place")
    return every.groupBy("task", "query").agg(F.min_by(F.struct("energy", "reason", "step", "place"), order).alias("x")).select("task", "query", "x.*")


def seeds(tasks: DataFrame, nodes: DataFrame, strategy: str = "semantic_lite", most: int = MOST_SEEDS) -> DataFrame:
    """(task, rank, id, energy, reason): the nodes of the strategy's steps, by energy, ties to what was asked first.

    A query stands for the only node of its name. Tasks that no step gave a seed are asked word by word at last. All steps meet
    the nodes in one join, then the first that gave a task a seed stays; of a name's nodes one row is left, so a common word
    costs a row a task.
    """
    wanted = asked(tasks, (*STRATEGIES[strategy], ("fallback",)))
    hits = resolve_unique(wanted.select(F.col("query").alias("ref"), F.col("query").alias("name")).distinct(), nodes).withColumnRenamed("ref", "query")
    found = wanted.join(hits, "query").withColumn("first", F.min("step").over(W.partitionBy("task"))).filter("step = first")
    one = found.groupBy("task", "id").agg(F.max("energy").alias("energy"), F.min("place").alias("place"), F.min_by(F.concat_ws(":", "reason", "query"), "place").alias("reason"))
    rank = F.row_number().over(W.partitionBy("task").orderBy(F.desc("energy"), "place", "id"))
    return one.withColumn("rank", rank).filter((F.col("rank") <= most) & (F.col("energy") >= LEAST)).select("task", "rank", "id", F.round("energy", 6).alias("energy"), "reason")
