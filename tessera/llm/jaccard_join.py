"""N-gram Jaccard join: documents link when their sets of word shingles overlap enough.

Candidates come from prefix filtering under several global token orders. Two sets of n and m
shingles with similarity t or more have o = ceil(t (n + m) / (1 + t)) in common, so under any one
order of all shingles the n - o + 1 first ones of one and the m - o + 1 first ones of the other
share one. Where m isn't known, n - ceil(t n) + 1 do; for the smaller set of a pair
n - ceil(2 t n / (1 + t)) + 1 do: its short prefix.
 - Rarest first: a document whose prefix is all its own has no partner. How often a shingle
   occurs is counted over all documents in cells of a hash, so an occurrence count of one is
   certain. What remains is counted again without the documents that went.
 - By a hash, after shingles that many documents share: this order is indexed. A shingle that is
   in nobody's short prefix lists nobody, so a passage that many documents share, each with much
   of its own, makes no candidates.
 - By further hashes: a candidate must share a prefix token under each of these too, before it
   is verified by its exact overlap.

The join finds the components of the link graph without listing all pairs of a group:
 1. documents with equal sets are one class, represented by its smallest id;
 2. the classes that share a prefix token form a list; each list links its members to one of
    them, its hub, where verified;
 3. lists whose members are in one component by then are done. In the others members meet by
    bitmaps of n to 2 n bits, whose differing bits bound the overlap: pairs of different
    components that these and their sizes allow, and whose smaller one has the list's shingle in
    its short prefix, go through the further orders to their exact overlap, some of each document
    at a time, nearest first, until no list has more. Lists with one smallest member are one list
    here, so a pair is told a few times at most.
No pair of a list is left out unless its two are connected already, so components are exact.
Lists of very frequent tokens are cut in chunks for the first hubs; after that they are one again.

Defined results: a null or empty text has an empty set, no links and its own id as component;
a text of fewer words than a shingle is one shingle of all its words; rows that repeat an id
and its text are alike; rows that repeat an id with different texts are texts of their own, and
all of them are in the component of that id; rows with a null id have a null component and no
links; an empty table gives an empty result; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, discard, fresh, give_back, packed, partitions, pick, scratch, sized, small_batches, text_chunks, unpacked, written
from tessera.llm.components import components
from tessera.llm.words import mix, shingle_sets, words

#: Seeds of the token orders; the first is indexed, the others filter.
ORDERS = (11, 23, 37)
#: A token that this many documents of one stretch of input share counts as frequent there.
STRETCH_TOKENS, STRETCH_COUNT = 1_000_000, 4
#: Frequent tokens that are put last: the most frequent so many (a fixed size to broadcast), each with so many documents.
LAST_TOKENS, LAST_COUNT = 100_000, 32
#: Postings that a task of the index is to hold; members of a list that meet at once; partners of a document that meet at once.
TASK_POSTINGS, LIST_CHUNK, PARTNERS = 2_000_000, 50_000, 256
#: Cells of a shard as bits; shingles that a shard is to hold; rounds of the rarest-first filter.
CELL_BITS, SHARD_TOKENS, ROUNDS = 24, 2_000_000, 2
#: Members of an open list that meet in a task, and their shingles (a single longer document is taken whole).
MEET_DOCS, MEET_SHINGLES = 4096, 8_000_000
#: Candidates that a document of an open list offers in the first turn, and how many times as many in each later one.
TURN = 8


def prefix_length(n, part: int = 4, whole: int = 5):
    """n - ceil(n * part / whole) + 1"""
    return n + (-(n * part) // whole) + 1


def overlap(n, m, part: int = 4, whole: int = 5):
    """ceil(t (n + m) / (1 + t)): what two sets of n and m shingles must have in common."""
    return -(-(n + m) * part // (part + whole))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows. 0: doc_id, n shingles, c1 and c2, a 128-bit digest of the set. 1: a frequent token (c1) and its documents (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                hashes, _, starts = words(data, offsets)
                sets = shingle_sets(hashes, starts, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                c = []
                for seed in (101, 202):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat, seed), dtype=np.uint64)])
                    ends = np.cumsum(n)
                    c.append(pa.array((total[ends] - total[ends - n]).view(np.int64)))
                yield rows(pa.array(np.zeros(end - first, np.int32)), batch.column(0).slice(first, end - first), pa.array(n), *c)
                held.append(flat)
                size += len(flat)
                if size >= STRETCH_TOKENS:
                    yield frequent(held)
                    held, size = [], 0
        if held:
            yield frequent(held)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), ["kind", "doc_id", "n", "c1", "c2"])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        many = count >= STRETCH_COUNT
        token, count = token[many].view(np.int64), count[many].astype(np.int64)
        return rows(pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), pa.int64()), pa.array(count), pa.array(token), pa.array(np.zeros(len(token), np.int64)))

    return docs.mapInArrow(run, "kind int, doc_id long, n long, c1 long, c2 long")


def with_partners(docs: DataFrame, k: int, part: int, whole: int, shards: int) -> DataFrame:
    """Ids of the documents (doc_id, text) whose prefix under the rarest-first order isn't all their own.

    Runs of documents send the cells of their shingles to the shards of the cells; shards return how many cells of each
    document occur once. A cell that occurs twice in a run is sent once, so a shingle that all documents share is one
    entry a run.
    """
    cells = 1 << CELL_BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        number, ids, sets, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                hashes, _, starts = words(data, offsets)
                sets += shingle_sets(hashes, starts, k)
                ids.append(batch.column(0).slice(first, end - first).to_numpy())
                size += len(hashes)
                if size >= STRETCH_TOKENS:
                    yield run_of(number, np.concatenate(ids), sets)
                    number, ids, sets, size = number + 1, [], [], 0
        if ids:
            yield run_of(number, np.concatenate(ids), sets)

    def run_of(number: int, ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        place = mix(np.concatenate(sets), 91) % np.uint64(shards * cells)
        owner = np.repeat(np.arange(1, len(n) + 1), n)
        order = np.argsort(place, kind="stable")
        place, owner = place[order].astype(np.int64), owner[order]
        new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        alone = np.diff(np.append(begin, len(place))) == 1
        place, owner = place[begin], np.where(alone, owner[begin], 0)
        shard = place // cells
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(shard))[: len(cut)]
        spans = list(zip(cut.tolist(), ends.tolist(), strict=True))
        gaps = [packed(np.diff(place[a:b] - shard[a] * cells, prepend=0)) for a, b in spans]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *shard[cut].tolist()], pa.int32()),
                pa.array([number] * (len(spans) + 1), pa.int64()),
                pa.array([ids.astype("<i8").tobytes(), *gaps], pa.binary()),
                pa.array([n.astype("<u4").tobytes(), *[packed(owner[a:b]) for a, b in spans]], pa.binary()),
            ],
            ["shard", "run", "x", "y"],
        )

    def count(group: pa.Table) -> pa.Table:
        give_back()
        runs = group.column("run").to_pylist()
        places = [np.cumsum(unpacked(x.as_py()), dtype=np.int64) for x in group.column("x")]
        owners = [unpacked(y.as_py()) for y in group.column("y")]
        flat = np.concatenate(places)
        order = np.argsort(flat, kind="stable")
        sorted_ = flat[order]
        differs = np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])
        alone = np.zeros(len(flat), dtype=bool)
        alone[order] = differs[:-1] & differs[1:]
        out, at = [], 0
        for owner in owners:
            mine = owner[alone[at : at + len(owner)]]
            out.append(packed(np.bincount(mine[mine > 0] - 1) if (mine > 0).any() else np.zeros(0, np.int64)))
            at += len(owner)
        return pa.table({"run": pa.array(runs, pa.int64()), "x": pa.nulls(len(runs), pa.binary()), "y": pa.array(out, pa.binary())})

    def settle(group: pa.Table) -> pa.Table:
        give_back()
        kept = np.zeros(0, np.int64)
        rows = list(zip(group.column("x").to_pylist(), group.column("y").to_pylist(), strict=True))
        for ids, n in [(np.frombuffer(x, "<i8"), np.frombuffer(y, "<u4").astype(np.int64)) for x, y in rows if x is not None]:
            own = np.zeros(len(ids), np.int64)
            for _, y in (r for r in rows if r[0] is None):
                some = unpacked(y)
                own[: len(some)] += some
            kept = ids[(n > 0) & (own < prefix_length(n, part, whole))]
        return pa.table({"doc_id": pa.array(kept.astype(np.int64))})

    sent = written(docs.mapInArrow(send, "shard int, run long, x binary, y binary"), "jaccard-cells")
    back = sent.filter("shard >= 0").groupBy("shard").applyInArrow(count, "run long, x binary, y binary")
    kept = written(sent.filter("shard < 0").select("run", "x", "y").unionByName(back).groupBy("run").applyInArrow(settle, "doc_id long"), "jaccard-kept")
    discard(sent)
    return kept


def postings(docs: DataFrame, last: np.ndarray, counts: np.ndarray, k: int, part: int, whole: int, tasks: int) -> DataFrame:
    """Rows (task, tokens, ids, sizes, chunks): the prefix postings of a run of documents that go to one task of the index.
    Sizes of documents with the token in their short prefix are negative.

    last, counts: tokens that are put last, sorted, and their documents. Very frequent ones go to several chunks of
    tasks: the chunks of a cut list count from 1, a list that isn't cut is chunk 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((last, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        late, often = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, end, data, offsets in text_chunks(batch.column(1)):
                tokens, owner, sizes, chunk = [], [], [], []
                hashes, _, starts = words(data, offsets)
                for doc, s in zip(ids[first:end].tolist(), shingle_sets(hashes, starts, k), strict=True):
                    if not len(s):
                        continue
                    p, short = prefix_length(len(s), part, whole), prefix_length(len(s), 2 * part, part + whole)
                    at = np.searchsorted(late, s)
                    at[at == len(late)] = 0
                    known = late[at] == s if len(late) else np.zeros(len(s), bool)
                    weight = np.where(known, often[at] if len(late) else 0, 0)
                    hashed = mix(s, ORDERS[0])
                    if known.any():
                        take = np.lexsort((hashed, weight))[:p]
                    else:
                        take = np.argpartition(hashed, (short - 1, p - 1))[:p]
                    chunks = -(-weight[take] // LIST_CHUNK)
                    tokens.append(s[take])
                    owner.append(np.full(p, doc, np.int64))
                    sizes.append(np.where(np.arange(p) < short, -len(s), len(s)).astype(np.int32))
                    chunk.append(np.where(chunks > 1, 1 + int(mix(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(1)) % np.maximum(chunks, 1), 0))
                if not tokens:
                    continue
                t, o, n, c = map(np.concatenate, (tokens, owner, sizes, chunk))
                task = ((mix(t, 5) + mix(c.astype(np.uint64), 6) * (c > 0)) % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                task, t, o, n, c = task[order], t[order], o[order], n[order], c[order]
                cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
                ends = np.append(cut[1:], len(task))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[cut].astype(np.int32)), *[pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in (t, o, n, c.astype(np.int32))]],
                    ["task", "tokens", "ids", "sizes", "chunks"],
                )

    return docs.mapInArrow(run, "task int, tokens binary, ids binary, sizes binary, chunks binary")


def lists_of(index: DataFrame, part: int, whole: int) -> DataFrame:
    """Kind 0: (a, b) a hub and a member of its list. Kind 1: a list of three or more, as key, chunk, ids and sizes (negative
    ones as in the postings)."""

    def run(group: pa.Table) -> pa.Table:
        give_back()
        t, o, n, c = (np.frombuffer(b"".join(group.column(x).to_pylist()), dtype=d) for x, d in (("tokens", np.uint64), ("ids", np.int64), ("sizes", np.int32), ("chunks", np.int32)))
        order = np.lexsort((o, c, t))
        t, o, n, c = t[order], o[order], n[order], c[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        fresh = new | np.concatenate([[True], o[1:] != o[:-1]])  # rows that repeat a document count once
        t, o, n, c, new = t[fresh], o[fresh], n[fresh], c[fresh], new[fresh]
        first, n = n < 0, np.abs(n)
        # who can have a partner here: not smaller than the least with the token in its short prefix, nor too large for the largest
        place = np.cumsum(new) - 1
        least, most = np.full(len(t), 1 << 40, np.int64), np.full(len(t), -1, np.int64)
        np.minimum.at(least, place[first], n[first])
        np.maximum.at(most, place[first], n[first])
        able = (c > 0) | ((n >= least[place]) & (n.astype(np.int64) * part <= most[place] * whole))
        t, o, n, c, first, place = t[able], o[able], n[able], c[able], first[able], place[able]
        new = np.concatenate([[True], place[1:] != place[:-1]]) if len(t) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(t)))
        hub = np.repeat(begin, size)
        a, b = o[hub], o
        close = (np.arange(len(t)) != hub) & (whole * np.minimum(n[hub], n).astype(np.int64) >= part * np.maximum(n[hub], n).astype(np.int64))
        pairs = np.unique(np.stack([a[close], b[close]], axis=1), axis=0) if close.any() else np.zeros((0, 2), np.int64)
        # equal lists of documents are one list; a chunk of a cut list keeps its token as key
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(o.view(np.uint64), 77), dtype=np.uint64)])
        key = (total[begin + size] - total[begin]).view(np.int64)
        cut = c[begin] > 0
        key = np.where(cut, t[begin].view(np.int64), key)
        long = np.flatnonzero((size > 2) | cut)
        _, once = np.unique(np.stack([key[long], c[begin[long]].astype(np.int64)], axis=1), axis=0, return_index=True) if len(long) else (None, np.zeros(0, np.int64))
        long = long[once]
        k = len(pairs)
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.zeros(k, np.int32), np.ones(len(long), np.int32)])),
                "a": pa.array(np.concatenate([pairs[:, 0], key[long]])),
                "b": pa.array(np.concatenate([pairs[:, 1], c[begin[long]].astype(np.int64)])),
                "ids": pa.array([None] * k + [o[begin[i] : begin[i] + size[i]] for i in long], pa.list_(pa.int64())),
                "sizes": pa.array([None] * k + [np.where(first, -n, n)[begin[i] : begin[i] + size[i]] for i in long], pa.list_(pa.int32())),
            }
        )

    return index.groupBy("task").applyInArrow(run, "kind int, a long, b long, ids array<long>, sizes array<int>")


def sets_of(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(doc_id, s): the sorted shingles of the documents asked for. docs: distinct ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                hashes, _, starts = words(data, offsets)
                found = [s.tobytes() for s in shingle_sets(hashes, starts, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(found, pa.binary())], ["doc_id", "s"])

    rows = docs.join(sized(asked), "doc_id", "left_semi").select("doc_id", "text")
    return written(rows.mapInArrow(run, "doc_id long, s binary"), "jaccard-sets")


def verified(pairs: DataFrame, docs: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Of the pairs (a, b) of ids those that link: prefixes under the filtering orders intersect, then the exact overlap decides."""
    loads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    loads = written(loads, "jaccard-loads")
    asked = written(pairs.select(F.col("b").alias("doc_id")).union(loads.select("a")).distinct(), "jaccard-asked")

    chosen = sets_of(docs, asked, k)
    # the short side goes to the sets, not the sets to it, while it is short
    asking = pairs.join(sized(loads), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    asking = F.broadcast(asking) if pairs.count() <= BROADCAST_ROWS else asking
    left = chosen.join(asking, F.col("b") == F.col("doc_id")).select("a", "part", "b", F.col("s").alias("member"))
    hubs = chosen.join(sized(loads.withColumnRenamed("a", "doc_id")), "doc_id").select(F.col("doc_id").alias("a"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("s").alias("hub"))

    def first_ones(s: np.ndarray, seed: int) -> np.ndarray:
        p = prefix_length(len(s), part, whole)
        hashed = mix(s, seed)
        return np.sort(np.partition(hashed, p - 1)[:p])

    def share(p: np.ndarray, q: np.ndarray, n: int, m: int) -> bool:
        need = overlap(n, m, part, whole)
        return len(np.intersect1d(p[: n - need + 1], q[: m - need + 1], assume_unique=True)) > 0

    def meet(members: pa.Table, hub: pa.Table) -> pa.Table:
        give_back()
        a, b = [], []
        if members.num_rows and hub.num_rows:
            x = np.frombuffer(hub.column("hub")[0].as_py(), dtype=np.uint64)
            own = [first_ones(x, seed) for seed in ORDERS[1:]]
            for other, s in zip(members.column("b").to_pylist(), members.column("member"), strict=True):
                y = np.frombuffer(s.as_py(), dtype=np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if whole * small >= part * large and all(share(p, first_ones(y, seed), len(x), len(y)) for p, seed in zip(own, ORDERS[1:], strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if whole * both >= part * (len(x) + len(y) - both):
                        a.append(hub.column("a")[0].as_py())
                        b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("a", "part").cogroup(hubs.groupBy("a", "part")).applyInArrow(meet, "a long, b long")


def open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the lists that are more than one component and have a short prefix, with their components."""
    known = members.join(labels, members["doc_id"] == labels["id"], "left").select("key", "chunk", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    known = written(known, "jaccard-members")
    open_ = (F.min("component") < F.max("component")) & (F.min("n") < 0)
    keys = written(known.groupBy("key").agg(open_.alias("open")).filter("open").select("key"), "jaccard-open")
    return known.join(sized(keys), "key")


def bitmaps_of(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(doc_id, bits): for each document asked for, whether an odd number of its shingles falls on each of n to 2 n bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                hashes, _, starts = words(data, offsets)
                found = []
                for s in shingle_sets(hashes, starts, k):
                    width = max(64, 1 << (len(s) - 1).bit_length())
                    odd = np.bincount((mix(s, 55) % np.uint64(width)).astype(np.int64), minlength=width) & 1
                    found.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(found, pa.binary())], ["doc_id", "bits"])

    return written(docs.join(sized(asked), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, bits binary"), "jaccard-bits")


def meetings(still: DataFrame, bits: DataFrame, part: int, whole: int, turn: int) -> DataFrame:
    """Candidate pairs (a, b) of different components in open lists; (null, null) if a later turn has more.

    The smaller of a pair must have the list's token in its short prefix, and sizes and bitmaps must allow the similarity:
    the bits that differ are no more than the shingles that do. Each document offers TURN of its candidates in the first
    turn, TURN times as many in each later one, the nearest first, so that what earlier turns joined isn't offered again.
    Long lists meet in pieces, two by two.
    """
    begin, end_ = TURN * (TURN**turn - 1) // (TURN - 1), TURN * (TURN ** (turn + 1) - 1) // (TURN - 1)
    loads = still.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEET_DOCS), F.ceil(F.sum(F.abs("n")) / MEET_SHINGLES)).cast("int").alias("pieces"))
    rows = still.join(sized(written(loads, "jaccard-pieces")), "key").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    other = F.explode(F.expr("sequence(0, pieces - 1)")).alias("other")
    rows = rows.join(bits, "doc_id").select("key", "doc_id", "n", "component", "bits", "piece", other).select(
        "key", "doc_id", "n", "component", "bits", "piece", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y")
    )
    task = F.pmod(F.xxhash64("key", "x", "y"), F.lit(16 * partitions(still))).alias("task")

    def run(group: pa.Table) -> pa.Table:
        give_back()
        group = group.sort_by([("key", "ascending"), ("x", "ascending"), ("y", "ascending"), ("doc_id", "ascending")])
        key, x, y, doc, n, comp, piece = (group.column(c).to_numpy() for c in ("key", "x", "y", "doc_id", "n", "component", "piece"))
        bits_, a, b, more = group.column("bits").combine_chunks(), [], [], False
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        ends = np.append(np.flatnonzero(new)[1:], len(key))
        for start, end in zip(np.flatnonzero(new).tolist(), ends.tolist(), strict=True):
            own = slice(start, end)
            if (comp[own] != comp[start]).any():
                for i, near in candidates(np.abs(n[own]).astype(np.int64), n[own] < 0, [bits_[j].as_py() for j in range(start, end)], part, whole):
                    if x[start] != y[start]:
                        near = near[piece[own][near] != piece[start + i]]
                    later = near[end_:]
                    more |= bool((comp[own][later] != comp[start + i]).any())
                    near = near[begin:end_]
                    near = near[comp[own][near] != comp[start + i]]
                    a += [int(doc[start + i])] * len(near)
                    b += doc[own][near].tolist()
        return pa.table({"a": pa.array([*a, *[None] * more], pa.int64()), "b": pa.array([*b, *[None] * more], pa.int64())})

    pairs = rows.withColumn("task", task).groupBy("task").applyInArrow(run, "a long, b long")
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-candidates")


def candidates(n: np.ndarray, first: np.ndarray, bits: list[bytes], part: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those that may link to the i-th, nearest first) of a list; a pair is told by its smaller one. first: who has the
    token in its short prefix."""
    width = np.array([len(x) for x in bits])
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    maps = {w: np.frombuffer(b"".join(bits[j] for j in at), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    folded = {w: m[:, : w // 16] ^ m[:, w // 16 :] for w, m in maps.items() if w > 8}
    number = np.arange(len(n))
    for i in np.flatnonzero(first).tolist():
        mine, found, gaps = np.frombuffer(bits[i], np.uint64), [], []
        for w, held in ((int(width[i]), maps), (2 * int(width[i]), folded)):
            if w not in rows:
                continue
            at = rows[w]
            able = (n[at] > n[i]) & (n[at] * part <= n[i] * whole) | (n[at] == n[i]) & first[at] & (number[at] > i)
            gap = np.bitwise_count(held[w][able] ^ mine).sum(axis=1, dtype=np.int64)
            at = at[able]
            close = (n[i] + n[at] - gap) // 2 >= overlap(n[i], n[at], part, whole)
            found.append(at[close])
            gaps.append(gap[close])
        if found and any(map(len, found)):
            found, gaps = np.concatenate(found), np.concatenate(gaps)
            yield i, found[np.lexsort((found, gaps))]


def across(members: DataFrame, links: DataFrame, docs: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """The components of all links, those that no hub found included: open lists meet, turn by turn, until none has more."""
    labels = written(components(links), "jaccard-labels")
    still = written(open_lists(members, labels), "jaccard-still")
    if still.isEmpty():
        return labels
    # a pair shares many lists, most of them with one smallest member: the lists of a smallest member become one
    hubs = written(still.groupBy("key").agg(F.min("doc_id").alias("hub")), "jaccard-hubs")
    merged = still.join(sized(hubs), "key").groupBy("hub", "doc_id").agg(F.min("n").alias("n"))
    merged = written(merged.select(F.col("hub").alias("key"), F.lit(0).alias("chunk"), "doc_id", "n"), "jaccard-merged")
    bits = bitmaps_of(docs, written(merged.select("doc_id").distinct(), "jaccard-asked"), k)
    turn = 0
    while True:
        still = written(open_lists(merged, labels), "jaccard-still")
        pairs = meetings(still, bits, part, whole, turn)
        told = pairs.filter("a IS NOT NULL")
        if not told.isEmpty():
            links = links.union(written(verified(told, docs, k, part, whole), "jaccard-links"))
            labels = written(components(links), "jaccard-labels")
        if pairs.filter("a IS NULL").isEmpty():
            return labels
        turn += 1


def join(df: DataFrame, k: int = 5, part: int = 4, whole: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Documents link at a similarity of part / whole or more."""
    spark = df.sparkSession
    scratch(spark)
    small_batches(spark)
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(signatures(docs, k), "jaccard-signatures")
    rows = seen.filter("kind = 0").select("doc_id", "n", "c1", "c2")
    differs = (F.min("c1") < F.max("c1")) | (F.min("c2") < F.max("c2"))
    ids = written(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), differs.alias("torn")).filter("m > 1"), "jaccard-ids")
    if not ids.filter("torn").isEmpty():
        return of_torn(docs, ids.filter("torn").select("doc_id"), k, part, whole)
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    classes = written(classes, "jaccard-classes")
    own = rows.join(sized(classes), ["c1", "c2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    own = written(own, "jaccard-own")
    others = written(own.filter("rep <> doc_id").select("doc_id").distinct(), "jaccard-others")
    reps = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").join(sized(others), "doc_id", "left_anti")
    shards = max(partitions(df), -(-total // SHARD_TOKENS))
    for _ in range(ROUNDS):
        reps = docs.join(sized(with_partners(reps, k, part, whole, shards)), "doc_id", "left_semi")

    if not ids.isEmpty():
        reps = reps.dropDuplicates(["doc_id"])

    frequent = seen.filter("kind = 1").groupBy(F.col("c1").alias("token")).agg(F.sum("n").alias("n")).filter(F.col("n") >= LAST_COUNT)
    top = frequent.orderBy(F.desc("n"), "token").limit(LAST_TOKENS).toArrow()
    last = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(last)
    tasks = max(partitions(df), -(-total // (4 * TASK_POSTINGS)))
    index = postings(reps, last[order], top.column("n").to_numpy()[order], k, part, whole, tasks)
    found = written(lists_of(index, part, whole), "jaccard-lists")

    pairs = written(found.filter("kind = 0").select("a", "b").distinct(), "jaccard-pairs")
    links = written(verified(pairs, reps, k, part, whole), "jaccard-links")
    lists = found.filter("kind = 1").select("a", "b", "ids", "sizes").dropDuplicates(["a", "b"])
    members = lists.select(F.col("a").alias("key"), F.col("b").cast("int").alias("chunk"), F.explode(F.arrays_zip("ids", "sizes")).alias("x"))
    members = written(members.select("key", "chunk", F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n")), "jaccard-postings")
    final = across(members, links, reps, k, part, whole)
    return own.join(final, own["rep"] == final["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def of_torn(docs: DataFrame, torn: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """As join(), where some ids have several texts: each such text is joined under a number of its own, then the components
    of an id's texts become one."""
    text_id = F.when(F.col("t").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    told = docs.join(sized(torn.withColumnRenamed("doc_id", "t")), F.col("doc_id") == F.col("t"), "left").select("doc_id", "t", "text", text_id.alias("text_id"))
    names = written(told.filter("t IS NOT NULL").select("text_id", F.col("doc_id").alias("name")).distinct(), "jaccard-names")
    found = join(told.select("text_id", "text"), k, part, whole, "text_id")
    found = found.join(sized(names), found["doc_id"] == names["text_id"], "left").select(F.coalesce("name", "doc_id").alias("doc_id"), F.col("name").isNotNull().alias("torn"), "n_shingles", "component_id")
    found = written(found, "jaccard-texts")
    pulled = found.filter("torn").select("doc_id", "component_id")
    links = pulled.join(pulled.groupBy("doc_id").agg(F.min("component_id").alias("b")), "doc_id").select(F.col("component_id").alias("a"), "b")
    merged = written(components(links), "jaccard-merged")
    found = found.join(sized(merged), found["component_id"] == merged["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("label"))
    least = written(found.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return found.join(sized(least), "label", "left").select("doc_id", "n_shingles", "component_id")


def one_of_each(df: DataFrame, k: int = 5, part: int = 4, whole: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of their component, with all their columns; rows with a null id stay, and so do rows
    that repeat such an id."""
    out = fresh(df, "gone")[0]
    gone = join(df, k, part, whole, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias(out)).distinct()
    gone = written(gone, "jaccard-gone")
    return df.join(sized(gone), df[f"`{id_col}`"] == gone[out], "left_anti")
