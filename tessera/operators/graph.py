"""Graph operators over edges (id, source, target, edge_type, weight, confidence) and nodes (id, ...).

Traversals are loops of joins over a frontier. Each hop is one equi-join on the node id and one
aggregation that keeps a row per node, so a hop's size is bounded by the nodes and never by the
paths. Edges that several hops read, and frontiers, are written to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import cut

#: Share of an activation that an edge of a kind lets through (fixed values).
ATTENUATION = {
    "Calls": 1.0, "Imports": 0.9, "DependsOn": 0.85, "UsedBy": 0.8, "References": 0.75, "Implements": 0.7, "Extends": 0.7, "Contains": 0.6, "Tests": 0.5, "Documents": 0.4,
}
CALLS = ("Calls", "UsedBy", "Imports")


def attenuation(kind: Column | str = "edge_type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ATTENUATION.items() for x in pair]), kind), F.lit(0.5))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last one of an id wins."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def insert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """The first one of an id wins; an edge without both endpoints isn't inserted."""
    ids = nodes.select("id")
    sound = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return edges.unionByName(sound.join(edges.select("id"), "id", "left_anti").select(edges.columns))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and, with them, their edges."""
    ids = gone.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(edges.columns)


def stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.round(F.coalesce(F.avg("weight"), F.lit(0.5)), 6).alias("avg_weight"),
        F.count_if(F.col("weight") >= 0.70).alias("strong"),
        F.count_if(F.col("weight") <= 0.15).alias("weak"),
        F.count_if(F.col("confidence") == "proven").alias("proven"),
    )


def inbound(edges: DataFrame, kinds: Sequence[str] = ("Calls", "UsedBy", "References")) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*kinds)).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"))


def neighbour_views(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: (id, neighbour, edge_id, edge_type, weight, direction). A loop appears twice."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), F.col("id").alias("edge_id"), "edge_type", "weight", F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), F.col("id").alias("edge_id"), "edge_type", "weight", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def walk(edges: DataFrame, ways: Callable[[DataFrame], DataFrame], seeds: DataFrame, hops: int) -> DataFrame:
    """Breadth-first from seeds (id): (id, depth), a node with its least depth. `ways` makes steps (src, dst) of edges (source, target):
    edges are written once, by their ends alone, and turned when they are read."""
    found = seeds.select("id", F.lit(0).alias("depth"))
    ends = edges.select("source", "target")
    frontier, steps = found, ways(cut(ends, "steps") if hops > 1 else ends)
    for depth in range(1, hops + 1):
        reached = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(found.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"))
        if depth < hops:
            frontier = cut(frontier, "frontier")
        found = found.unionByName(frontier)
    return found


def along(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def against(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return along(edges).union(against(edges))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids within so many hops of the seeds, either way, with their depth."""
    return walk(edges, both_ways, seeds, hops)


def trace(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 2) -> DataFrame:
    """Callers (in), callees (out) or both, which follows Contains too: (id, depth, score). Depth from 1 to 6."""
    depth = max(1, min(6, depth))
    kinds = CALLS if direction in ("in", "out") else (*CALLS, "Contains")
    used = edges.filter(F.col("edge_type").isin(*kinds))
    ways = {"out": along, "in": against}.get(direction, both_ways)
    return walk(used, ways, seeds, depth).filter("depth > 0").select("id", "depth", F.round(1 - 0.12 * F.col("depth"), 6).alias("score"))


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Size of what a change reaches: symbols, files, and the risk."""
    reached = trace(edges, seeds, "both", depth).join(nodes.select("id", "file_path"), "id")
    files = F.count_distinct("file_path")
    return reached.agg(F.count(F.lit(1)).alias("symbols"), files.alias("files")).withColumn("risk", F.when(F.col("symbols") >= 12, "high").when(F.col("symbols") >= 5, "medium").otherwise("low"))


def shortest_paths(edges: DataFrame, origin: str, hops: int) -> DataFrame:
    """Undirected breadth-first tree from one node: (id, depth, path). Of equal paths the one through the least node."""
    found = edges.sparkSession.createDataFrame([(origin, 0, [origin])], "id string, depth int, path array<string>")
    ends = edges.select("source", "target")
    frontier, steps = found, both_ways(cut(ends, "steps") if hops > 1 else ends)
    for depth in range(1, hops + 1):
        reached = frontier.select(F.col("id").alias("src")).join(steps, "src")
        best = reached.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("before"))
        fresh = best.join(found.select("id"), "id", "left_anti")
        # paths go to the nodes that they reach, not along each edge
        held = frontier.select(F.col("id").alias("before"), F.col("path").alias("head"))
        frontier = fresh.join(held, "before").select("id", F.lit(depth).alias("depth"), F.concat("head", F.array("id")).alias("path"))
        if depth < hops:
            frontier = cut(frontier, "frontier")
        found = found.unionByName(frontier)
    return found


def steiner_union(edges: DataFrame, origin: str, others: Sequence[str], hops: int) -> DataFrame:
    """Nodes on the paths from the first seed to each of the others."""
    paths = shortest_paths(edges, origin, hops).filter(F.col("id").isin(*others))
    return paths.select(F.explode("path").alias("id")).distinct()


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.7, cutoff: float = 0.05) -> DataFrame:
    """Spreading activation from seeds (id, energy): the most that reaches a node, less 0.15 of it for each hop made before."""
    steps = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), (F.col("weight") * attenuation()).alias("w"))
    steps = steps.union(edges.select("target", "source", F.col("weight") * attenuation()))
    steps = cut(steps, "steps") if hops > 1 else steps
    frontier = seeds.select("id", F.col("energy").cast("double").alias("energy"))
    reached = frontier
    for hop in range(hops):
        moved = frontier.select(F.col("id").alias("src"), "energy").join(steps, "src").select(F.col("dst").alias("id"), (F.col("energy") * decay * F.col("w")).alias("energy"))
        frontier = moved.filter(F.col("energy") >= cutoff).groupBy("id").agg(F.max("energy").alias("energy"))
        if hop < hops - 1:
            frontier = cut(frontier, "frontier")
        reached = reached.unionByName(frontier.select("id", (F.col("energy") * (1 - 0.15 * hop)).alias("energy")))
    return reached.groupBy("id").agg(F.round(F.max("energy"), 6).alias("energy"))


def next_nodes(edges: DataFrame, k: int = 3) -> DataFrame:
    """For each node the k targets with most weight after attenuation."""
    ranked = edges.withColumn("score", F.round(F.col("weight") * attenuation(), 6))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target", "id"))
    return ranked.withColumn("place", place).filter(F.col("place") <= k).select("source", "place", "target", "score")


def call_chain(edges: DataFrame, origin: str, depth: int = 4) -> DataFrame:
    """Follows each node's first outgoing call by edge id: (step, id)."""
    first = edges.filter("edge_type = 'Calls'").groupBy("source").agg(F.min_by("target", "id").alias("target"))
    at = edges.sparkSession.createDataFrame([(0, origin)], "step int, id string")
    chain = at
    for step in range(1, depth + 1):
        at = at.join(first, at["id"] == first["source"]).select(F.lit(step).alias("step"), F.col("target").alias("id"))
        chain = chain.unionByName(at)
    return chain


#: Nodes and edges beyond which the flow isn't solved.
TUBE_NODES, TUBE_EDGES = 250, 400


def beyond_tube(nodes: Sequence[str], edges: Sequence[tuple[str, str, float]]) -> bool:
    return len(nodes) > TUBE_NODES or len(edges) > TUBE_EDGES


def physarum(nodes: Sequence[str], edges: Sequence[tuple[str, str, float]], sources: Sequence[str], rounds: int = 30, sweeps: int = 40) -> dict[tuple[str, str], float]:
    """Flow over a small graph (at most 250 nodes and 400 edges): conductances grow where flow is and fade elsewhere.

    The first source has pressure 10, the other ones 0; pressures settle by Gauss-Seidel sweeps in order of node id,
    which is part of the result. Edges with less than 8 % of the largest flow or a conductance under 0.12 are pruned.
    """
    if beyond_tube(nodes, edges):
        return {}
    order = sorted(nodes)
    conductance = {(a, b): max(0.05, w) for a, b, w in edges}
    fixed = {s: 10.0 if i == 0 else 0.0 for i, s in enumerate(sources)}
    pressure = {n: fixed.get(n, 0.0) for n in order}
    around: dict[str, list[tuple[str, tuple[str, str]]]] = {n: [] for n in order}
    for a, b, _ in edges:
        around[a].append((b, (a, b)))
        around[b].append((a, (a, b)))
    flow: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for _ in range(sweeps):
            for n in order:
                total = sum(conductance[e] for _, e in around[n])
                if n not in fixed and total > 0:
                    pressure[n] = sum(conductance[e] * pressure[m] for m, e in around[n]) / total
        flow = {e: abs(conductance[e] * (pressure[e[0]] - pressure[e[1]])) for e in conductance}
        most = max(flow.values(), default=0.0)
        for e in conductance:
            grown = flow[e] / most if most > 0 else 0.0
            conductance[e] = 0.7 * conductance[e] + 0.3 * grown
    most = max(flow.values(), default=0.0)
    return {e: q for e, q in flow.items() if most > 0 and q >= 0.08 * most and conductance[e] >= 0.12}
