"""What belongs to a task's context: concepts, roles, gaps, impact, coverage and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What names stand for which concept, as (concept, contained, begins with, ends with, not contained).
CONCEPTS = (
    ("middleware", ("middleware",), (), (), ()), ("routing", ("router", "routing"), (), ("route",), ()), ("auth", ("authenticate",), ("auth",), (), ()), ("session", ("session", "cookie"), (), (), ()),
    ("repository", ("repository", "repo"), (), (), ()), ("render", ("template",), ("render",), (), ()), ("store", ("store",), (), (), ("restore",)), ("config", ("config", "settings"), (), (), ()),
    ("static", ("static", "asset"), (), (), ()), ("database", ("model", "schema"), (), (), ()), ("validation", ("valid", "schema"), (), (), ()), ("plugin", ("plugin", "encapsul"), (), (), ()),
    ("content_type", ("contenttype", "content-type", "parser"), (), (), ()),
)
#: Roles of a task's profile, and the words of a prompt that tell the profile, asked in this order.
ROLES = {
    "middleware": ("middleware", "use(", "pipeline", "next("), "routing": ("route", "router", "register", "handler", "endpoint", "api"), "session_auth": ("session", "cookie", "auth", "login", "sign"),
    "query_db": ("model", "repository", "query", "database", "adapter"), "testing": ("test", "spec", "mock"), "impact": ("affect", "break", "impact", "change", "modify"), "dependency_trace": ("caller", "callee", "depend", "import", "trace"),
    "refactoring": ("refactor", "rename", "export", "interface"), "configuration": ("config", "env", "settings", "setup"), "rendering": ("render", "template", "view", "engine"), "static_assets": ("static", "assets", "public"),
    "debugging": ("error", "exception", "bug", "fix"),
}
PROFILES = (
    ("middleware", ("middleware", "pipeline")), ("routing", ("route", "router", "endpoint")), ("session_auth", ("session", "auth", "cookie")), ("query_db", ("database", "model", "query")), ("testing", ("test", "spec")),
    ("impact", ("affect", "break", "impact")), ("dependency_trace", ("caller", "depend", "trace")), ("refactoring", ("refactor", "rename")), ("configuration", ("config", "env")), ("rendering", ("render", "template")),
    ("static_assets", ("static", "asset")), ("debugging", ("bug", "error", "debug")),
)
#: Besides its roles, what makes a gap critical: words of the path, words of the reason.
CRITICAL = {
    "middleware": (("middleware",), ("middleware", "auth")), "routing": (("route",), ("route", "router")), "session_auth": (("auth", "session"), ("auth", "session")), "impact": ((), ("caller", "callee", "depend")),
    "dependency_trace": ((), ("caller", "callee", "depend")),
}
ELSE_CRITICAL = ("required", "missing seed")
#: Words of a file's name or path by what a prompt traces.
PATTERNS = {
    "trace_routing": ("route", "router", "handler", "app", "endpoint"), "trace_middleware": ("middleware", "use", "pipeline", "next"), "trace_session": ("session", "cookie", "store", "config"),
    "trace_auth": ("auth", "login", "session", "middleware"), "trace_render": ("render", "template", "view", "engine"), "trace_static": ("static", "public", "asset"), "trace_query": ("model", "repository", "query", "adapter", "store"),
}
#: Words of a prompt that bring in files by their stems.
STEMS = (("plugin", ("plugin", "encapsul"), ("plugin", "middleware")), ("validation", ("validation", "validate"), ("validation", "schema", "validator")), ("errors", ("error", "fehler"), ("error", "handler", "serializer")), ("content_type", ("content-type", "content type"), ("content-type", "parser", "contenttype")))
#: Weights of the sufficiency of a packet, and its thresholds.
WEIGHTS = {"relevance": 0.25, "dependency": 0.20, "task_role": 0.20, "coherence": 0.10, "seed_confidence": 0.15}
GAP, UNRESOLVED, REDUNDANCY, OPEN_CONCEPT, LIKELY, PARTIAL = 0.15, 0.10, 0.05, 0.08, 0.72, 0.45
MOST_OF_CONCEPT, MOST_SEEDS, LEAST_SEED, MOST_PATTERN = 24, 6, 0.84, 6


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def concepts_of(name: Column) -> Column:
    """The concepts that a symbol's name stands for, in order."""
    low, found = F.lower(name), []
    for concept, within, starts, ends, without in CONCEPTS:
        hit = any_of(low, within)
        for w in starts:
            hit = hit | F.startswith(low, F.lit(w))
        for w in ends:
            hit = hit | F.endswith(low, F.lit(w))
        found.append(F.when(hit & ~any_of(low, without), concept))
    found.append(F.when(F.contains(low, F.lit("error")) & any_of(low, ("handler", "serial")), "errors"))
    return F.array_compact(F.array(*found))


def concept_index(symbols: DataFrame, most: int = MOST_OF_CONCEPT) -> DataFrame:
    """symbols (id, symbol): (concept, place, id, symbol), the first ones of each concept in order of id."""
    named = symbols.select("id", "symbol", F.explode(concepts_of(F.col("symbol"))).alias("concept"))
    place = F.row_number().over(W.partitionBy("concept").orderBy("id"))
    return named.withColumn("place", place).filter(F.col("place") <= most).select("concept", "place", "id", "symbol")


def concept_seeds(index: DataFrame, asked: DataFrame) -> DataFrame:
    """index: a concept index. asked (task, concept, identifiers, keywords, stems: lower-cased arrays): (task, id, place, score)."""
    low = F.lower("symbol")

    def said(column: str) -> Column:
        return F.exists(column, lambda w: F.contains(low, w))

    score = 0.72 + F.when(F.contains(low, F.col("concept")), 0.12).otherwise(0.0) + F.when(said("identifiers"), 0.18).otherwise(0.0) + F.when(said("keywords"), 0.15).otherwise(0.0)
    score = F.least(F.lit(0.95), score + 0.1 * F.size(F.filter("stems", lambda w: F.contains(low, w))))
    found = index.join(asked, "concept").filter(~F.contains("symbol", F.lit("."))).select("task", "id", F.round(score, 6).alias("score"))
    best = found.groupBy("task", "id").agg(F.max("score").alias("score")).filter(F.col("score") >= LEAST_SEED)
    return best.withColumn("place", F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= MOST_SEEDS).select("task", "id", "place", "score")


def profile(prompt: Column) -> Column:
    low, found = F.lower(prompt), F.lit("general")
    for name, words in reversed(PROFILES):
        found = F.when(any_of(low, words), name).otherwise(found)
    return found


def roles(kind: Column) -> Column:
    """The role words of a profile."""
    pairs = [x for name, words in ROLES.items() for x in (F.lit(name), F.array(*map(F.lit, words)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.array().cast("array<string>"))


def role_coverage(selected: DataFrame) -> DataFrame:
    """selected (task, prompt, path): (task, profile, coverage), the share of the profile's role words that a path has.

    A row for each role word that a path has, so nothing is collected; a task without a profile is covered.
    """
    told = selected.select("task", profile(F.col("prompt")).alias("profile"), F.lower("path").alias("path"))
    words = F.explode_outer(F.filter(roles(F.col("profile")), lambda w: F.contains("path", w)))
    hits = told.select("task", "profile", words.alias("word")).groupBy("task", "profile").agg(F.count_distinct("word").alias("hits"))
    n = F.size(roles(F.col("profile")))
    return hits.select("task", "profile", F.round(F.when(n == 0, 1.0).otherwise(F.col("hits") / n), 6).alias("coverage"))


def critical_gap(path: Column, reason: Column, kind: Column) -> Column:
    path, reason = F.lower(path), F.lower(reason)
    by_role = F.exists(roles(kind), lambda w: F.contains(path, w) | F.contains(reason, w))
    special = any_of(reason, ELSE_CRITICAL)
    for name, (of_path, of_reason) in CRITICAL.items():
        special = F.when(kind == name, any_of(path, of_path) | any_of(reason, of_reason)).otherwise(special)
    return by_role | special


def expand_by_pattern(files: DataFrame, edges: DataFrame, intents: DataFrame) -> DataFrame:
    """files (id, name, path), edges (a, b), intents (seed, intent): (seed, place, id), the first files around each seed and
    itself whose name or path has a word of the intent; all are fit for other intents."""
    near = edges.select(F.col("a").alias("seed"), F.col("b").alias("id")).union(edges.select("b", "a")).union(intents.select("seed", "seed")).distinct()
    text = F.concat_ws(" ", F.lower("name"), F.lower("path"))
    fits = F.lit(True)
    for intent, words in PATTERNS.items():
        fits = F.when(F.col("intent") == intent, any_of(text, words)).otherwise(fits)
    found = intents.join(near, "seed").join(files, "id").filter(fits)
    return found.withColumn("place", F.row_number().over(W.partitionBy("seed").orderBy("id"))).filter(F.col("place") <= MOST_PATTERN).select("seed", "place", "id")


def reached(edges: DataFrame, depth: int, back: bool) -> DataFrame:
    """edges (a, b): (origin, id) pairs within so many steps along the edges, or against them; a row a pair."""
    steps = edges.select(F.col("b").alias("a"), F.col("a").alias("b")) if back else edges.select("a", "b")
    steps = steps.distinct()
    found = steps.select(F.col("a").alias("origin"), F.col("b").alias("id"))
    last = found
    for _ in range(depth - 1):
        last = last.join(steps, last["id"] == steps["a"]).select("origin", F.col("b").alias("id")).distinct()
        found = found.union(last)
    return found.filter("origin <> id").distinct()


def impact(files: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """For each file what a change of it touches: (id, callers, callees, affected, tests, configs)."""
    callers, callees = reached(edges, depth, True), reached(edges, depth, False)
    kinds = callers.withColumn("kind", F.lit("caller")).union(callees.withColumn("kind", F.lit("callee"))).union(files.select("id", "id", F.lit("origin")))
    told = kinds.join(files.select("id", F.lower("path").alias("path")), "id")
    path = F.col("path")
    test = any_of(path, ("test", "spec"))
    config = any_of(path, ("config", ".env")) | path.rlike(r"\.(json|toml|ya?ml)$")

    def distinct(rule: Column) -> Column:
        return F.count_distinct(F.when(rule, path))

    return told.groupBy(F.col("origin").alias("id")).agg(
        distinct(F.col("kind") == "caller").alias("callers"), distinct(F.col("kind") == "callee").alias("callees"), distinct(F.lit(True)).alias("affected"), distinct(test).alias("tests"), distinct(config).alias("configs")
    )


def paths_match(gold: Column, path: Column) -> Column:
    return F.contains(path, gold) | F.endswith(gold, path)


def impact_scores(df: DataFrame) -> DataFrame:
    """df (id, gold, retrieved: short arrays of paths): (id, recall, precision)."""
    hit = F.filter("gold", lambda g: F.exists("retrieved", lambda r: paths_match(g, r)))
    right = F.filter("retrieved", lambda r: F.exists("gold", lambda g: paths_match(g, r)))
    recall = F.when(F.size("gold") == 0, 1.0).otherwise(F.size(hit) / F.size("gold"))
    precision = F.when(F.size("retrieved") == 0, 0.0).otherwise(F.size(right) / F.size("retrieved"))
    return df.select("id", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


def sufficiency(p: DataFrame) -> DataFrame:
    """p: hits, misses, dependency, task_role, coherence, seed_confidence, critical, non_critical, unresolved, redundancy,
    open_concepts (the share of the task's concepts that the packet lacks), over_budget. Adds score, confidence, claim, early_exit."""
    relevance = F.when(F.col("hits") + F.col("misses") == 0, 0.0).otherwise(F.col("hits") / (F.col("hits") + F.col("misses")))
    p = p.withColumn("relevance", relevance)
    raw = sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    raw = raw - GAP * (F.col("critical") + 0.25 * F.col("non_critical")) - UNRESOLVED * 0.1 * F.least(F.col("unresolved"), F.lit(5)) - REDUNDANCY * F.col("redundancy") - OPEN_CONCEPT * F.col("open_concepts")
    confidence = 0.4 * F.col("seed_confidence") + 0.3 * F.col("relevance") + 0.3 * F.col("task_role")

    def unit(x: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)

    p = p.withColumn("score", unit(raw)).withColumn("confidence", unit(confidence))
    held_back = (F.col("critical") > 0) | (F.col("open_concepts") > 0) | ((F.col("misses") > 0) & (F.col("task_role") < 0.5)) | (F.col("score") < PARTIAL)
    likely = (F.col("score") >= LIKELY) & (F.col("task_role") >= 0.67) & (F.col("dependency") >= 0.5) & (F.col("confidence") >= 0.70)
    claim = F.when(F.col("hits") == 0, "insufficient").when(held_back, "partial").when(likely, "likely_sufficient").otherwise("partial")
    return p.withColumn("claim", claim).withColumn("early_exit", (claim == "likely_sufficient") & ~F.col("over_budget"))


def escalation(p: DataFrame) -> DataFrame:
    """p: critical, early_exit, tokens, budget, resolved seeds, strong_lexical, vectors (whether any are loaded), best_cosine,
    least_cosine. Adds doubtful (the seeds align poorly with the prompt) and the level that the packet stops at."""
    weak = F.when(~F.col("vectors"), F.lit(True)).otherwise(F.coalesce(F.col("best_cosine") < F.col("least_cosine"), F.lit(False)))
    doubtful = (F.col("resolved") > 0) & ~F.col("strong_lexical") & weak
    stays = F.col("early_exit") & (F.col("tokens") <= F.col("budget")) & (F.col("critical") == 0) & ~doubtful
    return p.withColumn("doubtful", doubtful).withColumn("stays", stays).withColumn("escalates", (F.col("critical") > 0) | doubtful)


def seed_callees(nodes: DataFrame, edges: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """(id, callees): lower-cased names of what each symbol surely or probably calls, but for common ones; files have none."""
    calls = edges.filter("edge_type = 'Calls' AND confidence <> 'unresolved'").select("source", "target").distinct()
    seeds = nodes.filter("node_type <> 'File'").select(F.col("id").alias("source"))
    named = nodes.select(F.col("id").alias("target"), F.lower("name").alias("name")).filter(~F.col("name").isin(*common) if common else F.lit(True))
    return calls.join(seeds, "source", "left_semi").join(named, "target").groupBy(F.col("source").alias("id")).agg(F.count_distinct("name").alias("callees"))


def caller_files(edges: DataFrame, seeds: DataFrame, score: float = 17.0) -> DataFrame:
    """seeds (task, id) of tasks that need callers: (task, id, score) of the files that call them within two steps."""
    return seeds.withColumnRenamed("id", "origin").join(reached(edges, 2, True), "origin").select("task", "id").distinct().withColumn("score", F.lit(score))


def call_graph_only(optional: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """optional (task, place, id), seeds (task, id): those that are seeds or one step from one, the first ones by place."""
    one = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    near = seeds.join(one, seeds["id"] == one["a"]).select("task", F.col("b").alias("id")).union(seeds.select("task", "id")).distinct()
    kept = optional.join(near, ["task", "id"], "left_semi")
    return kept.withColumn("kept", F.row_number().over(W.partitionBy("task").orderBy("place"))).filter(F.col("kept") <= most).select("task", "id", "kept")


def app_locked(packet: DataFrame) -> DataFrame:
    """packet (task, id, app, schema, is_seed, asks_database): what stays. Where the seeds are of one app, files of other apps
    go; schema files go unless they are seeds or the prompt asks for the database."""
    apps = packet.filter("is_seed AND app IS NOT NULL").groupBy("task").agg(F.min("app").alias("first"), F.max("app").alias("last"))
    locked = apps.filter("first = last").select("task", F.col("first").alias("lock"))
    told = packet.join(locked, "task", "left")
    other = F.col("lock").isNotNull() & F.col("app").isNotNull() & (F.col("app") != F.col("lock"))
    return told.filter(F.col("is_seed") | ~(other | (F.col("schema") & ~F.col("asks_database")))).select("task", "id")


def stem_union(files: DataFrame, tasks: DataFrame, score: float) -> DataFrame:
    """files (id, stem, noise), tasks (task, prompt): (task, id, score) of the files whose stem fits a concept that the prompt names."""
    low, stem = F.lower("prompt"), F.col("stem")
    asked = F.array_compact(F.array(*[F.when(any_of(low, triggers), concept) for concept, triggers, _ in STEMS]))
    fits = F.array_compact(F.array(*[F.when(any_of(stem, patterns), concept) for concept, _, patterns in STEMS]))
    left = tasks.select("task", F.explode(asked).alias("concept"))
    right = files.filter("NOT noise").select("id", F.explode(fits).alias("concept"))
    return left.join(right, "concept").select("task", "id").distinct().withColumn("score", F.lit(score))


def assessed(candidates: DataFrame) -> DataFrame:
    """candidates (id, name, entity, concepts, confidence): (id, score, uncertainty, compression)."""
    low = F.lower("name")
    score = 0.5 + F.when(F.contains(low, F.lower("entity")), 0.4).otherwise(0.0) + 0.2 * F.size(F.filter("concepts", lambda c: F.contains(low, F.lower(c))))
    uncertainty = F.when(F.col("confidence") > 0.8, 0.15).otherwise(0.65)
    return candidates.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), uncertainty.alias("uncertainty"), F.when(uncertainty > 0.5, "conservative").otherwise("balanced").alias("compression"))


def outside_hints(hits: DataFrame) -> DataFrame:
    """hits (task, terms, blob; null for none): (task, matched, missed, confidence, sufficiency) of a search elsewhere: how many
    of the terms its files say. A row of a file at a time, terms are few."""
    said = hits.select("task", "terms", F.col("blob").isNotNull().alias("any"), F.explode_outer(F.filter("terms", lambda t: F.contains(F.lower("blob"), t))).alias("term"))
    by = said.groupBy("task", "terms").agg(F.max("any").alias("any"), F.count_distinct("term").alias("matched"))
    ratio = F.col("matched") / F.greatest(F.size("terms"), F.lit(1))
    confidence = F.when(F.col("any"), F.least(0.2 + 0.25 * ratio, F.lit(0.45))).otherwise(0.15)
    sufficient = F.when(F.col("any"), F.least(0.15 + 0.3 * ratio, F.lit(0.45))).otherwise(0.0)
    return by.select("task", "matched", (F.size("terms") - F.col("matched")).cast("long").alias("missed"), F.round(confidence, 6).alias("confidence"), F.round(sufficient, 6).alias("sufficiency"))
