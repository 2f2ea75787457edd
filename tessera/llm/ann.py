"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; a leaf that holds many rows is parted again by a tree of its own, fitted on
a bounded sample of the leaf. Every row is then indexed under its leaf. A query walks
the tree with a priority queue ordered by its inner product with the centroids and visits
leaves in that order. How many it visits is calibrated: for sample queries the true neighbours
are found by brute force over all rows, and visits widen until their mean recall reaches the
target. Queries and rows meet in bins of neighbouring leaves, of bounded size on both sides,
and a query looks only at the leaves it visits.

Nearness is the inner product in double precision; results are ordered by it, ties to the
smaller id. Equal vectors are one entry that carries its smallest ids, as many as an answer
can hold, so a vector that many rows share is one row of its leaf.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; rows that repeat an id and its vector count once; with fewer
candidates a query returns them all; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import pick, written

#: Vectors the tree is fitted on at most, and sample queries it is calibrated with.
SAMPLE, PROBES = 20_000, 200
#: Rows a leaf is to hold; children of a node; sample vectors a leaf needs.
LEAF_ROWS, BRANCH, LEAF_SAMPLE = 256, 16, 8
#: Rows from which a leaf is parted again, and vectors its own tree is fitted on at most: LEAF_SAMPLE of them a leaf again.
SPLIT_ROWS, SPLIT_SAMPLE = 1024, 512
#: Rows and queries that meet in one task.
ROW_CHUNK, QUERY_CHUNK = 8192, 4096


@dataclass
class Tree:
    """Nodes by number: their centroids, their children (none: a leaf), and each leaf's own number."""

    centroids: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)
    leaf: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, leaf_sample: int, branch: int = BRANCH, seed: int = 5) -> Tree:
        rng = np.random.default_rng(seed)
        centroids, children = [x.mean(axis=0)], [np.zeros(0, dtype=np.int64)]
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= leaf_sample:
                continue
            parts = kmeans(x[rows], min(branch, max(2, len(rows) // leaf_sample)), rng)
            if parts is None:
                continue
            own = []
            for c, members in parts:
                own.append(len(centroids))
                centroids.append(c)
                children.append(np.zeros(0, dtype=np.int64))
                waiting.append((own[-1], rows[members]))
            children[node] = np.array(own)
        return cls.numbered(np.array(centroids), children)

    @classmethod
    def numbered(cls, centroids: np.ndarray, children: list[np.ndarray]) -> Tree:
        leaves = [i for i, c in enumerate(children) if not len(c)]
        return cls(centroids, children, {n: i for i, n in enumerate(leaves)})

    def grafted(self, own: dict[int, Tree]) -> Tree:
        """With trees in place of leaves; leaves are numbered anew."""
        centroids, children = [self.centroids], list(self.children)
        node_of = {n: node for node, n in self.leaf.items()}
        for leaf, sub in sorted(own.items()):
            shift = len(children) - 1  # a tree's root is the leaf it takes the place of
            children[node_of[leaf]] = sub.children[0] + shift
            children += [c + shift for c in sub.children[1:]]
            centroids.append(sub.centroids[1:])
        return self.numbered(np.concatenate(centroids), children)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the nearest child."""
        out = np.zeros(len(x), dtype=np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            own = self.children[node]
            if not len(own):
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[own]
            nearest = np.argmax(x[rows] @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)
            for i, child in enumerate(own):
                if len(part := rows[nearest == i]):
                    waiting.append((int(child), part))
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if not len(own):
                yield self.leaf[node]
                continue
            for value, child in zip((self.centroids[own] @ q).tolist(), own.tolist(), strict=True):
                heapq.heappush(queue, (-value, child))

    def visits(self, q: np.ndarray, most: int, sizes: list[int], need: int) -> list[int]:
        """The first leaves; more of them until they hold as many rows as needed."""
        out, held = [], 0
        for leaf in self.walk(q):
            if len(out) >= most and held >= need:
                break
            out.append(leaf)
            held += sizes[leaf]
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Lloyd's algorithm; None where the rows cannot be parted."""
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    near = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)
        for i in range(k):
            if (mine := near == i).any():
                c[i] = x[mine].mean(axis=0)
    parts = [(c[i], np.flatnonzero(near == i)) for i in range(k)]
    parts = [(m, r) for m, r in parts if len(r)]
    return parts if len(parts) > 1 else None


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(
    queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int, leaf: np.ndarray | None = None, visited: list[list[int]] | None = None
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of the rows' ids: (query's number, (score, id) in order). leaf, visited: the rows'
    leaves and those that a query visits; others are left out."""
    least = np.array([i[0] for i in ids])
    take = min(len(rows), k + 13)
    if leaf is not None:
        present, leaf = np.unique(leaf, return_inverse=True)
        place = {n: i for i, n in enumerate(present.tolist())}
    for at in range(0, len(queries), 128):
        rough = queries[at : at + 128] @ rows.T
        if leaf is not None:
            open_ = np.zeros((len(rough), len(present)), dtype=bool)
            for i in range(len(rough)):
                open_[i, [place[n] for n in visited[at + i] if n in place]] = True
            rough[~open_[:, leaf]] = -np.inf
        top = np.partition(rough, len(rows) - take, axis=1)[:, len(rows) - take]
        for i in range(len(rough)):
            # all that come near the last one taken, or tie with it, are looked at exactly
            edge = top[i] - 1e-9 if np.isfinite(top[i]) else -np.finfo(np.float64).max
            chosen = np.flatnonzero(rough[i] >= edge)
            exact = (queries[at + i] * rows[chosen]).sum(axis=1)
            order = np.lexsort((least[chosen], -exact))[: k + 1]
            found = [(float(exact[j]), v) for j in order for v in ids[chosen[j]] if v != own[at + i]]
            yield at + i, sorted(found, key=lambda s: (-s[0], s[1]))[:k]


def search(df: DataFrame, k: int = 20, recall: float = 0.95, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per query and neighbour found: query_id, rank, vec_id, score. Queries: rows whose id is divisible by `every`."""
    spark = df.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    element = df.schema[vector_col].dataType.elementType.simpleString()
    element = element if element == "float" else "double"  # the components as they are: products are those of the original vectors
    rows = pick(df, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(f"array<{element}>").alias("v"))
    sound = rows.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    dims = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], kind)
    dim, total = dims["d"], dims["count"]
    sound = sound.filter(F.size("v") == dim)

    # a vector with its smallest ids: more than k + 1 of equal vectors can be in no answer
    ranked = sound.distinct().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")
    entries = written(entries, "ann-entries")
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("v").toArrow()
    x = matrix(sample.column(0), dim)
    tree = deepened(entries, Tree.fit(x, max(LEAF_SAMPLE, round(LEAF_ROWS * len(x) / max(1, total)))), dim, element)
    # bounded by the samples: SAMPLE / LEAF_SAMPLE leaves, each parted into SPLIT_SAMPLE / LEAF_SAMPLE at most
    shared = spark.sparkContext.broadcast(tree)
    index = written(placed(entries, shared, dim, element), "ann-index")
    asked = sound.filter(F.col("vec_id") % every == 0).distinct()
    probes = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], kind)
    most = calibrate(index, matrix(probes.column("v"), dim), probes.column("vec_id").to_numpy(), tree, dim, k, recall)

    # leaves side by side share a bin of about ROW_CHUNK rows; a larger leaf is several bins. A row a leaf
    first, bins, sizes, at, held = [0] * len(tree.leaf), [1] * len(tree.leaf), [0] * len(tree.leaf), 0, 0
    for leaf, n in sorted((r["leaf"], r["count"]) for r in index.groupBy("leaf").count().collect()):
        if held and held + n > ROW_CHUNK:
            at, held = at + 1, 0
        first[leaf], bins[leaf], sizes[leaf] = at, -(-n // ROW_CHUNK), n
        held += n
        at, held = (at + bins[leaf], 0) if bins[leaf] > 1 else (at, held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bin_, leaves, take = [], [], []
                for i, q in enumerate(matrix(part.column(1), dim)):
                    mine: dict[int, list[int]] = {}
                    for leaf in shared.value.visits(q, most, sizes, k + 1):
                        for b in range(first[leaf], first[leaf] + bins[leaf]):
                            mine.setdefault(b, []).append(leaf)
                    bin_ += mine.keys()
                    leaves += mine.values()
                    take += [i] * len(mine)
                at = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(bin_, pa.int32()), part.column(0).take(at), part.column(1).take(at), pa.array(leaves, pa.list_(pa.int32()))], ["bin", "query_id", "q", "leaves"])

    routed = written(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(route, f"bin int, query_id long, q array<{element}>, leaves array<int>"), "ann-routed")
    loads = F.broadcast(routed.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("parts")))  # a row a bin
    left = routed.join(loads, "bin").select("bin", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "q", "leaves")
    plan = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(first, bins, strict=True))], "leaf int, first int, bins int"))
    binned = index.join(plan, "leaf").withColumn("bin", (F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("bins"))).cast("int"))
    right = binned.join(loads, "bin").select("bin", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "leaf", "ids", "v")

    def meet(asking: pa.Table, rows: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if asking.num_rows and rows.num_rows:
            own = asking.column("query_id").to_numpy()
            found = best(matrix(asking.column("q"), dim), own, matrix(rows.column("v"), dim), rows.column("ids").to_pylist(), k, rows.column("leaf").to_numpy(), asking.column("leaves").to_pylist())
            for i, near in found:
                q += [int(own[i])] * len(near)
                s += [x for x, _ in near]
                v += [x for _, x in near]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    place_of = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place_of).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def placed(entries: DataFrame, shared: Broadcast, dim: int, element: str) -> DataFrame:
    """(leaf, ids, v): each entry with its leaf in a tree that was broadcast."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column(0), batch.column(1)], ["leaf", "ids", "v"])

    return entries.mapInArrow(place, f"leaf int, ids array<long>, v array<{element}>")


def deepened(entries: DataFrame, tree: Tree, dim: int, element: str) -> Tree:
    """The tree with each leaf of more than SPLIT_ROWS rows parted by a tree of its own. Leaves are fitted by executors, on
    SPLIT_SAMPLE vectors at most, which are picked before they are shuffled; the driver holds their centroids alone."""
    spark = entries.sparkSession
    first = placed(entries, spark.sparkContext.broadcast(tree), dim, element)
    large = [(r["leaf"], r["count"]) for r in first.groupBy("leaf").count().filter(F.col("count") > SPLIT_ROWS).collect()]
    if not large:
        return tree
    order = W.partitionBy("leaf").orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0])
    picked = first.join(F.broadcast(spark.createDataFrame(large, "leaf int, n long")), "leaf").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SPLIT_SAMPLE)

    leaf_rows, leaf_sample = LEAF_ROWS, LEAF_SAMPLE

    def fit(rows: pa.Table) -> pa.Table:
        leaf, n, x = rows.column("leaf")[0].as_py(), rows.column("n")[0].as_py(), matrix(rows.column("v"), dim)
        x = x[np.argsort(rows.column("place").to_numpy())]
        own = Tree.fit(x, max(leaf_sample, round(leaf_rows * len(x) / n)), seed=leaf)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(own)], pa.binary())})

    fitted = picked.select("leaf", "n", "place", "v").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect()
    return tree.grafted({r.leaf: pickle.loads(r.tree) for r in fitted})


def calibrate(index: DataFrame, probes: np.ndarray, own: np.ndarray, tree: Tree, dim: int, k: int, recall: float) -> int:
    """Leaves to visit such that the probes' mean recall against brute force over all rows reaches the target."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, int]]] = [[] for _ in probes]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_pylist()
            leaf = {v: n for group, n in zip(ids, batch.column(0).to_pylist(), strict=True) for v in group}
            for i, found in best(probes, own, matrix(batch.column(2), dim), ids, k):
                held[i] = sorted(held[i] + [(-s, v, leaf[v]) for s, v in found])[:k]
        flat = [(i, s, v, n) for i, x in enumerate(held) for s, v, n in x]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["probe", "s", "vec_id", "leaf"])

    rough = index.mapInArrow(nearest, "probe int, s double, vec_id long, leaf int")
    place_of = F.row_number().over(W.partitionBy("probe").orderBy("s", "vec_id"))
    truth = rough.withColumn("n", place_of).filter(F.col("n") <= k).select("probe", "leaf").collect()  # PROBES x k rows
    leaves = len(tree.leaf)
    wanted: list[set[int]] = [set() for _ in probes]
    for r in truth:
        wanted[r.probe].add(r.leaf)
    ranks: list[dict[int, int]] = [{} for _ in probes]
    for q, leaves_of, rank in zip(probes, wanted, ranks, strict=True):
        for i, leaf in enumerate(tree.walk(q), 1):
            if len(rank) == len(leaves_of):
                break
            if leaf in leaves_of:
                rank[leaf] = i
    need = np.array([ranks[r.probe][r.leaf] for r in truth])
    if not len(need):
        return leaves
    widths = np.sort(need)
    return int(min(leaves, widths[min(len(widths) - 1, int(np.ceil(recall * len(widths))) - 1)]))
