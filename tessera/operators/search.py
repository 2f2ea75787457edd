"""Symbol search, ranking and name resolution over nodes (id, node_type, name, file_path, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.paths import hint_match, stem, test_like
from tessera.functions.text import identifier_tokens, specificity

CLASS_LIKE = ("Class", "Component", "Api")
TYPE_RANK = ("Class", "Component", "Api", "Function", "Symbol", "File", "Config")


def type_rank(kind: Column) -> Column:
    ranked = F.lit(len(TYPE_RANK))
    for i, name in reversed(list(enumerate(TYPE_RANK))):
        ranked = F.when(kind == name, i).otherwise(ranked)
    return ranked


def learning_bonus(access: Column | str, relevance: Column | str) -> Column:
    access = F.col(access) if isinstance(access, str) else access
    relevance = F.col(relevance) if isinstance(relevance, str) else relevance
    lift = 5 * F.log1p(access) + 10 * F.greatest(relevance - 1, F.lit(0.0)) - 12 * F.greatest(1 - relevance, F.lit(0.0))
    return F.greatest(F.lit(0.0), lift)


def ranking_bonus(query: Column | str) -> Column:
    """Kind, exactness, specificity, path echo, and what was learned; test paths lose."""
    query = F.lower(F.col(query) if isinstance(query, str) else query)
    kind = F.when(F.col("node_type").isin(*CLASS_LIKE), 8.0).when(F.col("node_type") == "Function", 4.0).otherwise(0.0)
    exact = F.when(F.lower("name") == query, 16.0).otherwise(0.0)
    echo = F.when(F.exists(F.split(F.lower("file_path"), "/"), lambda s: s == query), 12.0).otherwise(0.0)
    stems = F.when(F.lower(stem("file_path")) == query, 30.0).otherwise(0.0)
    tests = F.when(test_like("file_path"), -24.0).otherwise(0.0)
    return kind + exact + 10 * specificity(query, F.col("name")) + echo + stems + tests + learning_bonus("access_count", "base_relevance")


def search(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """For each query (q) its best symbols: q, place, id, name, reason, score.

    A symbol counts by the first of exact, prefix, substring, token and path that finds it, whatever scores more.
    Substrings count only if no symbol of any kind is exact, tokens only if no class-like one is. Whatever finds a symbol,
    its name or path has the query's first three letters in a row, so queries and nodes meet by an equality join on such
    runs. Queries are a bounded set; their runs are a constant of the plan. Ranks are cut per query before the shuffle.
    """
    limit = max(1, min(80, limit))
    asked = queries.select("q", F.lower("q").alias("low")).filter("q <> ''").distinct()
    low = F.col("low")
    asked = asked.withColumn("run", F.substring("low", 1, 3))
    runs = sorted(r.run for r in asked.select("run").distinct().toLocalIterator())
    text = F.concat_ws("\n", F.lower("name"), F.lower("file_path"))
    hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(r)), r) for r in runs] or [F.lit(None).cast("string")]))
    name = F.col("low_name")
    prepared = nodes.withColumn("run", F.explode(hits)).withColumns({"low_name": F.lower("name"), "low_path": F.lower("file_path")})
    spec = specificity(low, F.col("name"))
    class_like = F.col("node_type").isin(*CLASS_LIKE)
    found = prepared.join(F.broadcast(asked), "run").filter(F.contains(name, low) | F.contains("low_path", low))
    exact = nodes.select(F.lower("name").alias("low"), class_like.alias("class_like")).join(F.broadcast(asked), "low").groupBy("low").agg(F.max("class_like").alias("class_exact"))
    marked = found.join(F.broadcast(exact), "low", "left").withColumn("is_exact", name == low)  # a row a query
    marked = marked.withColumn("any_exact", F.col("class_exact").isNotNull()).withColumn("class_exact", F.coalesce("class_exact", F.lit(False)))
    priority = (
        F.when(F.col("is_exact"), 1)
        .when(F.startswith(name, low), 2)
        .when(F.contains(name, low) & ~F.col("any_exact"), 3)
        .when(F.array_contains(identifier_tokens("name"), low) & ~F.col("class_exact"), 4)
        .when(F.contains("low_path", low), 5)
    )
    base = (
        F.when(F.col("priority") == 1, F.when(class_like, 240.0).otherwise(120.0))
        .when(F.col("priority") == 2, 80 + 12 * spec)
        .when(F.col("priority") == 3, 48 + 28 * spec)
        .when(F.col("priority") == 4, 74.0)
        .otherwise(70.0)
    )
    reason = F.element_at(F.array(*map(F.lit, ("exact", "prefix", "substring", "token", "path"))), F.col("priority"))
    scored = marked.withColumn("priority", priority).filter("priority IS NOT NULL").withColumn("score", F.round(base + ranking_bonus("q"), 6)).withColumn("reason", reason)
    order = W.partitionBy("q").orderBy(F.desc("is_exact"), type_rank(F.col("node_type")), F.desc("score"), F.length("name"), "id")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("q", "place", "id", "name", "reason", "score")


def resolve_unique(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (ref, name): the node of that name, case aside, if there is exactly one."""
    named = nodes.select(F.lower("name").alias("key"), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    return refs.select("ref", F.lower("name").alias("key")).join(named, "key").select("ref", "id")


def resolve_scoped(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (ref, name, file_path, package): the only node of that name in the narrowest scope that has just one: file, package, all.

    Nodes are counted by name and scope first, so a ref meets one row of each scope however many nodes share its name.
    """
    named = nodes.select(F.lower("name").alias("key"), "file_path", "package", "id")
    asked = refs.select("ref", F.lower("name").alias("key"), "file_path", "package")
    for scope, place in (("a", ["key", "file_path"]), ("b", ["key", "package"]), ("c", ["key"])):
        asked = asked.join(only_one(named, place).withColumnRenamed("id", scope), place, "left")
    scope = F.when(F.col("a").isNotNull(), "file").when(F.col("b").isNotNull(), "package").otherwise("global")
    return asked.withColumn("id", F.coalesce("a", "b", "c")).filter("id IS NOT NULL").select("ref", "id", scope.alias("scope"))


def only_one(rows: DataFrame, place: list[str]) -> DataFrame:
    """The id of each place that has just one."""
    return rows.groupBy(*place).agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").drop("last")


def resolve_dominant(candidates: DataFrame, margin: float = 8.0) -> DataFrame:
    """candidates (ref, id, score): the best one; proven if it leads by the margin or stands alone, else likely."""
    order = W.partitionBy("ref").orderBy(F.desc("score"), "id")
    led = candidates.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).filter("place = 1")
    proven = F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)
    return led.select("ref", "id", F.round("score", 6).alias("score"), F.when(proven, "proven").otherwise("likely").alias("confidence"))


def resolve_hint(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref, hint), files (path): the only file whose path is or ends with the hint.

    The suffixes of each path become keys, so this is an equality join: paths have few segments.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keyed = files.select("path", F.explode(suffixes).alias("hint"))
    only = keyed.groupBy("hint").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1")
    return refs.join(only, "hint").select("ref", "path")


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (path), manifests (dir, manifest): the deepest ancestor directory that has a manifest, by an equality join on ancestors."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))).alias("x")).select("path", "x.depth", "x.dir")
    order = W.partitionBy("path").orderBy(F.desc("depth"), "manifest")
    return up.join(manifests, "dir").withColumn("k", F.row_number().over(order)).filter("k = 1").select("path", "dir", "manifest")


def hinted(candidates: DataFrame) -> DataFrame:
    """candidates (ref, hint, path): those whose path matches the hint."""
    return candidates.filter(hint_match("path", "hint"))


def resolve_export(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref, name, hint), symbols (name, id, file_path): (ref, id, confidence) among symbols of the name whose path holds the hint.

    The files of a name meet its hints, each once, with their counts; references and symbols of a frequent name never make pairs.
    """
    held = symbols.groupBy("name", "file_path").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = refs.select("name", "hint").distinct().join(held, "name").filter(F.contains("file_path", F.col("hint")))
    told = found.groupBy("name", "hint").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    each = refs.groupBy("ref", "name", "hint").agg(F.count(F.lit(1)).alias("times")).join(told, ["name", "hint"])
    return each.groupBy("ref").agg(F.min("id").alias("id"), F.when(F.sum(F.col("n") * F.col("times")) == 1, "proven").otherwise("likely").alias("confidence"))
