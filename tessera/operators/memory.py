"""What is remembered: reinforcement of edges, learning by file, caches, passages and their vectors, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import neighbour_views
from tessera.operators.learning import clamp, pheromone_fold
from tessera.operators.search import learning_bonus

LEARNED = ("Calls", "Imports", "References", "UsedBy")
#: What a node's kind is called in a sketch, kinds without one, and lengths of its parts.
UNSKETCHED = ("File", "Directory", "Project", "Api")
SIGNATURE, DOC = 180, 120
VERSIONS, HIERARCHICAL = (4, 6), 6


def reinforce_path(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """edges (id, source, target, weight), steps (source, target, ts, seq, success) of paths in order of time: (id, weight) of the
    edges that a path went along. Each step adds 0.15 or takes 0.10, clamped every time."""
    walked = steps.join(edges.select("source", "target", "id"), ["source", "target"])
    events = walked.select(F.col("id").alias("key"), "ts", "seq", F.when(F.col("success"), "reinforce").otherwise("penalise").alias("kind"))
    return pheromone_fold(events).select(F.col("key").alias("id"), "weight")


def reinforce_around(edges: DataFrame, touched: DataFrame, success: bool = True) -> DataFrame:
    """touched (id): (id, weight) of the distinct call, import, reference and use edges at any of them, once reinforced or penalised."""
    near = edges.filter(F.col("edge_type").isin(*LEARNED))
    ids = touched.select("id").distinct()
    whole = near.select("id", "weight", "source", "target")
    hit = [near_to(whole, end, ids).join(ids.withColumnRenamed("id", end), end, "left_semi").select("id", "weight") for end in ("source", "target")]
    return hit[0].union(hit[1]).distinct().select("id", F.round(clamp(F.col("weight") + (0.15 if success else -0.10)) + 1e-9, 6).alias("weight"))


#: Ids whose hashes are broadcast, at 16 bytes or so each.
BROADCAST_IDS = 8_000_000


def near_to(edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """The edges whose end may be among distinct ids, by a broadcast of the ids' hashes: what surely isn't is never shuffled. Of too many
    ids all edges stay; an exact join follows in any case."""
    if ids.count() > BROADCAST_IDS:
        return edges
    hashes = ids.select(F.xxhash64("id").alias("hash")).distinct()
    return edges.join(F.broadcast(hashes), F.xxhash64(end) == F.col("hash"), "left_semi")  # a plain condition goes down to the scans


def learning_profile(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(id, access_count, base_relevance, bonus, place, neighbour, edge_type, weight): what is learned of each node, and its first
    neighbours in order of edge; a node without any has one row."""
    place = F.row_number().over(W.partitionBy("id").orderBy("edge_id", "neighbour"))
    near = neighbour_views(edges).withColumn("place", place).filter(F.col("place") <= most).select("id", "place", "neighbour", "edge_type", F.round(F.col("weight") + 1e-9, 6).alias("weight"))
    own = nodes.select("id", "access_count", "base_relevance", F.round(learning_bonus("access_count", "base_relevance"), 6).alias("bonus"))
    return own.join(near, "id", "left")


def file_learning(nodes: DataFrame) -> DataFrame:
    """(file_path, boost, least_relevance): the most that was learned of a file or its symbols, and the least relevance."""
    return nodes.groupBy("file_path").agg(F.round(F.max(learning_bonus("access_count", "base_relevance")), 6).alias("boost"), F.round(F.min("base_relevance"), 6).alias("least_relevance"))


def high_learning(nodes: DataFrame, least: float, most: int) -> DataFrame:
    """The files with most boost, at least so much."""
    return file_learning(nodes).filter(F.col("boost") >= least).orderBy(F.desc("boost"), "file_path").limit(most).select("file_path", "boost")


def matching_patterns(patterns: DataFrame, words: Sequence[str]) -> DataFrame:
    """patterns (id, domain, intent): (word, id) where the domain or the intent contains the word, case aside."""
    both = [F.lower("domain"), F.lower("intent")]
    hit = F.array_compact(F.array(*[F.when(F.contains(both[0], F.lit(w.lower())) | F.contains(both[1], F.lit(w.lower())), w) for w in words]))
    return patterns.select(F.explode(hit).alias("word"), "id")


def response_cache(events: DataFrame) -> DataFrame:
    """events (project, key, seq, kind): `put` stores under the exact key, `clear` empties the project's cache, `get` asks.

    (project, key, seq, hit): a get hits the last put of its key if no clear came after that."""
    keyed = W.partitionBy("project", "key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("project").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    put = F.last(F.when(F.col("kind") == "put", F.col("seq")), True).over(keyed)
    cleared = F.last(F.when(F.col("kind") == "clear", F.col("seq")), True).over(whole)
    told = events.withColumn("put", put).withColumn("cleared", cleared).filter("kind = 'get'")
    hit = F.col("put").isNotNull() & (F.col("cleared").isNull() | (F.col("put") > F.col("cleared")))
    return told.select("project", "key", "seq", F.when(hit, F.col("put")).alias("hit"))


def packet_cache(puts: DataFrame, most: int = 32, most_bytes: int = 1 << 20, ttl: int = 600) -> DataFrame:
    """puts (project, key, ts, seq, size): (project, key, place, held) of what a cache per project still holds at its last put:
    the newest put of a key, none older than the time to live, the newest ones up to the number and the bytes."""
    newest = F.row_number().over(W.partitionBy("project", "key").orderBy(F.desc("ts"), F.desc("seq")))
    last = F.max("ts").over(W.partitionBy("project"))
    live = puts.withColumn("now", last).withColumn("k", newest).filter("k = 1").filter(F.col("now").cast("long") - F.col("ts").cast("long") <= ttl)
    order = W.partitionBy("project").orderBy(F.desc("ts"), F.desc("seq"))
    held = live.withColumn("place", F.row_number().over(order)).withColumn("held", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return held.filter((F.col("place") <= most) & (F.col("held") <= most_bytes)).select("project", "key", "place", "held")


def memo(asked: DataFrame) -> DataFrame:
    """asked (scope, text): (scope, asked, embedded): within a scope each text is embedded once, whatever its case and blanks."""
    return asked.groupBy("scope").agg(F.count(F.lit(1)).alias("asked"), F.count_distinct(F.lower(F.trim("text"))).alias("embedded"))


def sketch(path: Column, name: Column, kind: Column, signature: Column, doc: Column) -> Column:
    """The text that stands for a symbol when it is embedded; null for kinds that have none."""
    title = F.when(path == "", name).otherwise(F.concat(path, F.lit("::"), name))
    signature, doc = F.trim(F.coalesce(signature, F.lit(""))), F.trim(F.coalesce(doc, F.lit("")))
    shown = F.concat(
        F.lit("title: "), title, F.lit(" | text: "), F.lower(kind), F.when(signature == "", "").otherwise(F.concat(F.lit(" "), F.substring(signature, 1, SIGNATURE))),
        F.when(doc == "", "").otherwise(F.concat(F.lit(" - "), F.substring(doc, 1, DOC))),
    )
    return F.when(~kind.isin(*UNSKETCHED), shown)


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (id, hash of the text): (id, action). A vector is reused where the text is as before, else embedded; vectors of
    nodes that went are dropped."""
    both = old.select("id", F.col("hash").alias("before")).join(new.select("id", F.col("hash").alias("after")), "id", "full")
    action = F.when(F.col("after").isNull(), "drop").when(F.col("before") == F.col("after"), "reuse").otherwise("embed")
    return both.select("id", action.alias("action"))


def compatible(sidecars: DataFrame, model: str, dim: int, generation: int, digest: str) -> DataFrame:
    """sidecars (id, version, model, dim, generation, digest, files): (id, fits, hierarchical)."""
    fits = F.col("version").between(*VERSIONS) & (F.col("model") == model) & (F.col("dim") == dim) & (F.col("generation") == generation) & (F.col("digest") == digest)
    return sidecars.select("id", fits.alias("fits"), (fits & (F.col("version") >= HIERARCHICAL) & (F.col("files") > 0)).alias("hierarchical"))


def lazy_symbols(symbols: DataFrame, per_file: int = 32, most: int = 128) -> DataFrame:
    """symbols (task, prompt, file, file_place, id, name): (task, file, id, overlap), those whose names the prompt says most, so
    many of a file, then so many in all in order of files. A whole name counts 3, a part of four letters 1."""
    low, name = F.lower("prompt"), F.lower("name")
    parts = F.filter(F.split(name, "[^a-z0-9]"), lambda p: F.length(p) >= 4)
    overlap = F.when((F.length(name) >= 3) & F.contains(low, name), 3).otherwise(0) + F.size(F.filter(parts, lambda p: F.contains(low, p)))
    ranked = symbols.select("task", "file", "file_place", "id", overlap.alias("overlap"))
    ranked = ranked.withColumn("k", F.row_number().over(W.partitionBy("task", "file").orderBy(F.desc("overlap"), "id"))).filter(F.col("k") <= per_file)
    return ranked.withColumn("place", F.row_number().over(W.partitionBy("task").orderBy("file_place", "k"))).filter(F.col("place") <= most).select("task", "file", "id", "overlap")


def manifest_prefixes(manifests: DataFrame) -> DataFrame:
    """manifests (name, content): (prefix, folder) of Go modules and of the name spaces that composer loads."""
    module = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
    go = manifests.filter("name = 'go.mod'").select(module.alias("prefix"), F.lit("").alias("folder")).filter("prefix <> ''")
    spaces = [F.coalesce(F.from_json(F.get_json_object("content", f"$['{a}']['{b}']"), "map<string,string>"), F.create_map().cast("map<string,string>")) for a, b in (("autoload", "psr-4"), ("autoload", "psr-0"), ("autoload-dev", "psr-4"))]
    entries = F.explode(F.concat(*[F.map_entries(m) for m in spaces]))
    clean = lambda x: F.rtrim(F.replace(x, F.lit("\\"), F.lit("/")), F.lit("/"))
    composer = manifests.filter("name = 'composer.json'").select(entries.alias("e")).select(clean(F.col("e.key")).alias("prefix"), clean(F.col("e.value")).alias("folder"))
    return go.union(composer.filter("prefix <> ''")).distinct()


def rewrite_imports(hints: DataFrame, prefixes: DataFrame) -> DataFrame:
    """hints (ref, hint), prefixes (prefix, folder): (ref, path) by the longest prefix, whose folder takes its place.

    Each hint's own prefixes are keys of an equality join: hints have few parts.
    """
    parts = F.split(F.replace("hint", F.lit("\\"), F.lit("/")), "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
    found = hints.select("ref", F.explode(cuts).alias("x")).select("ref", "x.*").join(prefixes, "prefix")
    path = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.when(F.col("rest") != "", F.col("rest")))
    best = found.withColumn("path", path).filter("path <> ''").groupBy("ref").agg(F.max_by("path", F.struct("depth", F.col("folder"))).alias("path"))
    return best.select("ref", "path")


def inbound_pending(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """changed (file_path): edges from outside into nodes of the files, as (source, edge_type, name, file_path), to be resolved anew
    once the files are read."""
    inside = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id", "name", "file_path")
    used = edges.filter(F.col("edge_type").isin("Calls", "Imports", "DependsOn", "References", "UsedBy"))
    into = near_to(used, "target", inside.select("id").distinct()).join(inside.withColumnRenamed("id", "target"), "target").join(inside.select(F.col("id").alias("source")), "source", "left_anti")
    return into.select("source", "edge_type", "name", "file_path").distinct()


def fitness(df: DataFrame) -> DataFrame:
    """df (id, original, skeleton, sound, types): (id, fitness) of a way to fold: half compression, a third soundness, the rest types."""
    saved = F.greatest(F.lit(0), F.col("original") - F.col("skeleton")) / F.col("original")
    score = 0.50 * saved + 0.35 * F.col("sound").cast("double") + 0.15 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("types")))
    return df.select("id", F.round(F.when(F.col("original") == 0, 0.0).otherwise(score), 6).alias("fitness"))


def random_folding(seed: Column) -> list[Column]:
    """(folds, docs, depth, boost) that a seed stands for."""
    share = lambda a, b: F.pmod(seed * F.lit(a) + F.lit(b), F.lit(100)) / 100.0
    return [(3 + F.pmod(seed, F.lit(7))).alias("folds"), (0.5 + share(1103515245, 12345) * 0.5).alias("docs"), (1 + F.pmod(seed, F.lit(3))).alias("depth"), (1.0 + share(1664525, 1013904223)).alias("boost")]


def next_generation(population: DataFrame, generation: int, rate: float = 0.20) -> DataFrame:
    """population (run, place, folds, docs, depth, boost, fitness): the same columns after a generation, by run.

    The two fittest stay (ties to the smaller place); the others are bred from pairs of the four fittest, one row a run, and
    mutate by the digits of generation and place. Children have no fitness yet.
    """
    order = W.partitionBy("run").orderBy(F.desc("fitness"), "place")
    ranked = population.withColumn("at", F.row_number().over(order) - 1)
    genes = ("folds", "docs", "depth", "boost")
    fittest = ranked.filter("at < 4").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", *genes))).alias("top"))
    parent = lambda step: F.element_at("top", (F.pmod(F.col("at") + step, F.size("top")) + 1).cast("int"))
    bred = ranked.join(fittest, "run").withColumn("a", parent(0)).withColumn("b", parent(1))
    seed = F.col("at") + generation
    changes, delta = F.pmod(seed, F.lit(100)) / 100.0 < rate, F.when(F.pmod(seed, F.lit(2)) == 0, 1).otherwise(-1)

    def gene(name: str, child: Column, step: float | None, least: float = 0, most: float = 0) -> Column:
        moved = child if step is None else F.when(changes, F.greatest(F.lit(least), F.least(F.lit(most), child + delta * F.lit(step)))).otherwise(child)
        return F.when(F.col("at") < 2, F.col(name)).otherwise(moved).alias(name)

    mean = lambda name: (F.col(f"a.{name}") + F.col(f"b.{name}")) / 2
    return bred.select(
        "run", F.col("at").cast("long").alias("place"), gene("folds", F.floor(mean("folds")), 1, 2, 15).cast("long").alias("folds"), gene("docs", mean("docs"), 0.05, 0.1, 1.0),
        gene("depth", F.greatest("a.depth", "b.depth"), None), gene("boost", mean("boost"), 0.1, 0.5, 3.0), F.when(F.col("at") < 2, F.col("fitness")).otherwise(0.0).alias("fitness"),
    )


def merged_signals(df: DataFrame, most: int = 8) -> DataFrame:
    """df (task, own, client: arrays of words): (task, keywords), the client's first, each once whatever its case, so many."""
    words = F.filter(F.transform(F.concat("client", "own"), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    return df.select("task", F.slice(F.array_distinct(words), 1, most).alias("keywords"))


def line_changes(versions: DataFrame) -> DataFrame:
    """versions (id, before, after): (id, side, line, text) of the lines that only one of two texts has, with their numbers from 1;
    equal texts have none."""

    def lines(column: str) -> Column:
        text = F.regexp_replace(F.coalesce(column, F.lit("")), "\\n$", "")
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\\n"), lambda x: F.regexp_replace(x, "\\r$", "")))

    told = versions.filter(~F.col("before").eqNullSafe(F.col("after"))).select("id", lines("before").alias("old"), lines("after").alias("new"))

    def only(side: str, here: str, there: str) -> DataFrame:
        kept = F.filter(F.transform(here, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda s: ~F.array_contains(there, s["text"]))
        return told.select("id", F.lit(side).alias("side"), F.explode(kept).alias("x")).select("id", "side", "x.line", "x.text")

    return only("added", "new", "old").unionByName(only("removed", "old", "new"))


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (ref, name, hint, file_path, package), methods (id, name, parent, file_path, package): (ref, id, tier).

    The receiver decides first: `impl:` and `type:` name the method's type, `field:` and `obj:` a thing whose name ends its
    type's. A call that its receiver doesn't settle goes to the only method of that name in its file, its package, or at
    all. Methods are counted by each key first, so a call meets one row a tier.
    """
    asked = calls.select("ref", F.lower("name").alias("name"), F.split("hint", ":")[0].alias("by"), F.lower(F.replace(F.coalesce(F.try_element_at(F.split("hint", ":"), F.lit(2)), F.lit("")), F.lit("_"), F.lit(""))).alias("thing"), "file_path", "package")
    held = methods.select("id", F.lower("name").alias("name"), F.coalesce("parent", F.lit("")).alias("parent"), "file_path", "package")
    words = F.filter(F.split(F.regexp_replace("parent", "(?<=[a-z0-9])(?=[A-Z])", "_"), "_"), lambda w: w != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda i: F.lower(F.array_join(F.slice(words, i, F.size(words)), "")))

    def one(rows: DataFrame, place: list[str], tier: str) -> DataFrame:
        return rows.groupBy(*place).agg(F.min("id").alias(tier), F.max("id").alias("last")).filter(F.col(tier) == F.col("last")).drop("last")

    typed = one(held.withColumn("thing", F.lower(F.replace("parent", F.lit("_"), F.lit("")))).filter("thing <> ''"), ["name", "thing"], "typed")
    ended = one(held.withColumn("thing", F.explode(ends)).filter("thing <> ''"), ["name", "thing"], "ended")
    out = asked.join(typed, ["name", "thing"], "left").join(ended, ["name", "thing"], "left")
    for place, tier in ((["name", "file_path"], "in_file"), (["name", "package"], "in_package"), (["name"], "anywhere")):
        out = out.join(one(held, place, tier), place, "left")
    by_type, by_thing = F.when(F.col("by").isin("impl", "type"), F.col("typed")), F.when(F.col("by").isin("field", "obj"), F.col("ended"))
    tiers = [("receiver", by_type), ("thing", by_thing), ("file", F.col("in_file")), ("package", F.col("in_package")), ("global", F.col("anywhere"))]
    tier = F.lit(None).cast("string")
    for name, found in reversed(tiers):
        tier = F.when(found.isNotNull(), name).otherwise(tier)
    return out.withColumn("id", F.coalesce(*[c for _, c in tiers])).withColumn("tier", tier).filter("id IS NOT NULL").select("ref", "id", "tier")
