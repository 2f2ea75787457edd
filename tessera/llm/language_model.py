"""LM scoring: a bigram model by absolute discounting, held in Elias-Fano tries, one a shard.

P(w | c) = (max(n(c, w) - D, 0) + D * s(c) * U(w)) / n(c), with s(c) the distinct words after c in
training and U the add-one unigram base; after a context that training lacks it is U(w). It sums
to one over the vocabulary and one unknown word.

All documents train but the held-out ones. The corpus is cut in runs of documents. Each run
sends the counts of its words to the words' shards and gets corpus counts back. A bigram whose
first or second word occurs in this run alone has its corpus count there already, and the run
keeps it in a trie of its own; all others go to their contexts' shards. A shard merges the runs'
counts into a trie. Every trie has the same levels (contexts, pointers, successors, quantised
probabilities), and every trained bigram is answered from one by successor search within its
context, so scores depend neither on runs nor on partitions. Contexts with very many tokens are
spread over shards by successor. So no task holds more than a share of the corpus, whatever its
size.

Defined results: a null text is empty and scores its end alone; with no training rows every
word is unknown; ids are of any type, and a null id is never held out; repeated rows, and rows
that repeat an id with other texts, are scored, and count, once each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import packed, partitions, pick, text_chunks, unpacked, written
from tessera.llm.elias_fano import STEPS, Trie, quantised, restored
from tessera.llm.words import mix, words

#: Hashes that stand for the end of a text and the context of its first word.
END, START = np.uint64(0x1D8AF066F4A1C3B5), np.uint64(0x93C467E37DB0C7A4)
DISCOUNT = 0.75
#: Tokens of a run, and of a shard; a context with more tokens than HOT is spread.
RUN_TOKENS, SHARD_TOKENS, HOT = 2_000_000, 2_000_000, 2_000_000
#: In place of a quantised probability: the bigram isn't in training.
ABSENT = STEPS + 1


def runs_of(docs: DataFrame, shards: int) -> DataFrame:
    """docs: doc_id, text, held_out. Kind 0: a run of documents (a: ids' places in Arrow, b: held out, c: lengths, d: vocabulary, e: tokens). Kind 1: its
    words of one shard (a) and their training counts (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, lengths, hashes, size = [], [], [], [], 0
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                found, _, start = words(data, offsets)
                n = np.diff(start)
                ids.append(batch.column(0).slice(first, end - first))
                held.append(batch.column(2).slice(first, end - first).to_numpy(zero_copy_only=False))
                lengths.append(n + 1)
                hashes.append(np.insert(found, start[1:], END))
                size += int(n.sum()) + len(n)
                if size >= RUN_TOKENS:
                    yield table(number, ids, held, lengths, hashes)
                    ids, held, lengths, hashes, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield table(number, ids, held, lengths, hashes)

    def table(number: int, ids: list, held: list[np.ndarray], lengths: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        length, flat, out = np.concatenate(lengths), np.concatenate(hashes), np.concatenate(held).astype(bool)
        vocab, token, often = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        token, vocab = rank[token], np.append(vocab[order], START)
        train = np.repeat(~out, length)
        local = np.bincount(token[train], minlength=len(vocab))
        local[-1] = int((~out).sum())
        by, cut = by_shard(vocab, shards)
        rows = [(0, -1, packed_ids(ids), np.packbits(out).tobytes(), packed(length), vocab.tobytes(), packed(token))]
        for s, part in zip(cut[0], np.split(by, cut[1][1:]), strict=True):
            rows.append((1, int(s), vocab[part].tobytes(), packed(local[part], "<u8"), None, None, None))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
            ["kind", "run", "shard", "a", "b", "c", "d", "e"],
        )

    return docs.mapInArrow(run, "kind int, run long, shard int, a binary, b binary, c binary, d binary, e binary")


def packed_ids(ids: list[pa.Array]) -> bytes:
    """The ids as they came, of whatever type."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Places ordered by their words' shard, and (shards that occur, where each begins)."""
    shard = (mix(hashes, 3) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return order, (shard[begin], begin)


def merge_words(group: pa.Table, shards: int) -> pa.Table:
    """Of each run's words of this shard, in the run's order, twice the corpus count, plus one if other runs have the word
    too (a), and the word's number in the corpus (b); and, as run -1, the distinct words and tokens."""
    runs, shard = group.column("run").to_pylist(), group.column("shard")[0].as_py()
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("a")]
    local = np.concatenate([unpacked(x.as_py(), "<u8") for x in group.column("b")])
    found, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(found), dtype=np.uint64)
    np.add.at(total, place, local)
    real = found != START
    several = np.bincount(place, minlength=len(found)) > 1
    told = total * np.uint64(2) + several.astype(np.uint64)
    # the words' numbers: frequent ones get small numbers, which pack well
    order = np.lexsort((found, -total.astype(np.int64)))
    code = np.empty(len(found), dtype=np.int64)
    code[order] = np.arange(len(found)) * shards + shard
    counts, codes, at = [], [], 0
    for p in parts:
        counts.append(packed(told[place[at : at + len(p)]], "<u8"))
        codes.append(packed(code[place[at : at + len(p)]], "<u8"))
        at += len(p)
    n = len(runs)
    return pa.table(
        {
            "kind": pa.array([1] * (n + 1), pa.int32()),
            "run": pa.array([*runs, -1], pa.int64()),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "a": pa.array([*counts, None], pa.binary()),
            "b": pa.array([*codes, None], pa.binary()),
            "v": pa.array([0] * n + [int((real & (total > 0)).sum())], pa.int64()),
            "n": pa.array([0] * n + [int(total[real].sum())], pa.int64()),
        }
    )


class Run:
    """A run's documents with corpus counts: its distinct bigrams, and which of them the run knows alone."""

    def __init__(self, row: dict, back: pa.Table, shards: int):
        self.shards = shards
        self.ids = pa.ipc.open_stream(row["a"]).read_all().column(0).combine_chunks()
        self.length = unpacked(row["c"]).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(row["b"], np.uint8), count=len(self.length)).astype(bool)
        self.vocab = np.frombuffer(row["d"], np.uint64)
        self.token = unpacked(row["e"]).astype(np.int64)
        size = len(self.vocab)
        self.count, self.code = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        got = {r["shard"]: (r["a"], r["b"]) for r in back.to_pylist() if r["kind"] == 1}
        by, (present, begin) = by_shard(self.vocab, shards)
        for s, part in zip(present.tolist(), np.split(by, begin[1:]), strict=True):
            self.count[part] = unpacked(got[s][0], "<u8").astype(np.int64)
            self.code[part] = unpacked(got[s][1], "<u8").astype(np.int64)
        alone = self.count % 2 == 0
        self.count //= 2
        train = np.repeat(~self.held, self.length)
        before = np.empty(len(self.token), dtype=np.int64)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.length) - self.length] = size - 1
        keys, self.bigram = np.unique(before * size + self.token, return_inverse=True)
        self.n = np.bincount(self.bigram[train], minlength=len(keys))
        self.context, self.word = keys // size, keys % size
        self.known = alone[self.context] | alone[self.word] | (self.count[self.context] == 0) | (self.count[self.word] == 0)
        #: distinct trained words after a context among the bigrams that only this run has
        self.own = np.bincount(self.context[self.known & (self.n > 0)], minlength=size)
        self.alone = alone
        # what is asked: contexts not known alone, each in its first shard and those that its words spread to
        self.spread = 1 + self.count // HOT
        asked = np.flatnonzero(~self.known)
        shard = self.shard_of(self.context[asked], self.code[self.word[asked]] // shards % self.spread[self.context[asked]])
        order = np.lexsort((self.code[self.word[asked]], self.code[self.context[asked]], shard))
        self.asked, self.asked_shard = asked[order], shard[order]
        seen = np.flatnonzero(np.bincount(self.context, minlength=size) > 0)
        seen = seen[~alone[seen] & (self.count[seen] > 0)]
        repeat = self.spread[seen]
        self.places = np.repeat(seen, repeat)
        subs = np.arange(len(self.places)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        shard = self.shard_of(self.places, subs)
        # a context whose spreads meet in a shard is one place there
        _, once = np.unique(shard * size + self.places, return_index=True)
        self.places, subs, shard = self.places[once], subs[once], shard[once]
        order = np.lexsort((self.code[self.places], shard))
        self.places, self.first, self.places_shard = self.places[order], (subs == 0)[order], shard[order]

    def shard_of(self, context: np.ndarray, sub: np.ndarray) -> np.ndarray:
        return (mix(self.vocab[context] + sub.astype(np.uint64), 9) % np.uint64(self.shards)).astype(np.int64)

    def messages(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]]:
        """By shard: contexts, their corpus counts, their distinct words known here alone, how many bigrams follow, words, counts."""
        asked_key, place_key = self.code[self.context[self.asked]], self.code[self.places]
        for s in np.unique(self.places_shard).tolist():
            a, b = np.searchsorted(self.places_shard, [s, s + 1])
            c, d = np.searchsorted(self.asked_shard, [s, s + 1])
            places, asked = self.places[a:b], self.asked[c:d]
            follow = np.searchsorted(asked_key[c:d], place_key[a:b], side="right") - np.searchsorted(asked_key[c:d], place_key[a:b])
            yield (
                s, packed(self.code[places], "<u8"), packed(self.count[places], "<u8"), packed(np.where(self.first[a:b], self.own[places], 0)),
                packed(follow), packed(self.code[self.word[asked]], "<u8"), packed(self.n[asked]),
            )

    def own_steps(self, discount: float) -> np.ndarray:
        """Quantised probabilities of the bigrams that this run knows alone, from a trie of them."""
        context, word, n = (x[self.known] for x in (self.context, self.word, self.n))
        places, follow = np.unique(context, return_counts=True)
        trained = n > 0
        held, each = np.unique(context[trained], return_counts=True)
        logs = np.log10((n[trained] - discount) / self.count[context[trained]])
        trie = Trie.mapped(Trie.encode(held.astype(np.uint64), each, word[trained].astype(np.uint64), logs))
        found = trie.lookup(places.astype(np.uint64), follow, word.astype(np.uint64))
        return np.where(np.isnan(found), ABSENT, quantised(np.nan_to_num(found)))

    def score(self, back: pa.Table, tokens: int, distinct: int, discount: float) -> pa.RecordBatch:
        steps = np.full(len(self.context), ABSENT, dtype=np.int64)
        follow = np.where(self.alone, self.own, 0)
        for r in back.to_pylist():
            if r["kind"] != 2:
                continue
            a, b = np.searchsorted(self.places_shard, [r["shard"], r["shard"] + 1])
            c, d = np.searchsorted(self.asked_shard, [r["shard"], r["shard"] + 1])
            np.add.at(follow, self.places[a:b], unpacked(r["a"]).astype(np.int64))
            steps[self.asked[c:d]] = np.frombuffer(r["b"], "<u2")
        unigram = (self.count + 1.0) / (tokens + 1.0 * (distinct + 1))
        n = self.count[self.context]
        steps[self.known] = self.own_steps(discount)
        share = np.where(steps == ABSENT, 0.0, 10.0 ** restored(np.minimum(steps, ABSENT - 1)))
        rest = discount * follow[self.context] / np.maximum(n, 1)
        logs = np.log10(np.where(n > 0, share + rest * unigram[self.word], unigram[self.word]))[self.bigram]
        begin = np.cumsum(self.length) - self.length
        base = np.add.reduceat(np.log10(unigram)[self.token], begin)
        known = np.add.reduceat((self.count[self.token] > 0).astype(np.int64), begin)
        return pa.table(
            {
                "doc_id": self.ids,
                "held_out": pa.array(self.held),
                "n_tokens": pa.array(self.length),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(self.length), tokens, dtype=np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(np.add.reduceat(logs, begin)),
            }
        )


def build_trie(contexts: np.ndarray, counts: np.ndarray, own: np.ndarray, of: np.ndarray, successors: np.ndarray, n: np.ndarray, discount: float) -> tuple[Trie, np.ndarray, np.ndarray]:
    """A shard's trie, its sorted contexts, and the distinct trained words after each. of: each bigram's place in `contexts`."""
    found, first, place = np.unique(contexts, return_index=True, return_inverse=True)
    total, known = counts[first], np.zeros(len(found), dtype=np.int64)
    np.add.at(known, place, own)
    context = place[of]
    order = np.lexsort((successors, context))
    context, successors, n = context[order], successors[order], n[order]
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (successors[1:] != successors[:-1])]) if len(context) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    n = np.add.reduceat(n, begin) if len(begin) else n
    context, successors = context[begin], successors[begin]
    trained = n > 0
    context, successors, n = context[trained], successors[trained], n[trained]
    each = np.bincount(context, minlength=len(found))
    logs = np.log10(np.maximum(n - discount, 1e-12) / total[context])
    kept = each > 0
    trie = Trie.mapped(Trie.encode(found[kept], each[kept], successors, logs))
    return trie, found, known + each


def score(df: DataFrame, folds: int = 7, fold: int = 2, discount: float = DISCOUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    id_type = df.schema[id_col].dataType
    kind = id_type.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("held_out", held)
    # about six bytes a word; the sizes of shards need no more
    size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    shards = max(partitions(df), -(-size // SHARD_TOKENS))
    first = written(runs_of(docs, shards), "lm-runs")
    runs = first.filter("kind = 0").select("run", "a", "b", "c", "d", "e")
    counted = written(first.filter("kind = 1").select("run", "shard", "a", "b").groupBy("shard").applyInArrow(lambda group: merge_words(group, shards), "kind int, run long, shard int, a binary, b binary, v long, n long"), "lm-words")
    sums = counted.filter("run = -1").agg(F.sum("v"), F.sum("n")).first()
    distinct, tokens = sums[0] or 0, sums[1] or 0
    back = counted.filter("run >= 0").select("kind", "run", "shard", "a", "b")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            rows += [(row["run"], *m) for m in Run(row, right, shards).messages()]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.table({"run": pa.array(columns[0], pa.int64()), "shard": pa.array(columns[1], pa.int32())} | {x: pa.array(columns[2 + i], pa.binary()) for i, x in enumerate("abcdef")})

    asked = runs.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(ask, "run long, shard int, a binary, b binary, c binary, d binary, e binary, f binary")

    def answer(group: pa.Table) -> pa.Table:
        runs_, shard = group.column("run").to_pylist(), group.column("shard")[0].as_py()
        take = lambda name, kind: [unpacked(x.as_py(), kind).astype(np.int64) for x in group.column(name)]
        contexts = [unpacked(x.as_py(), "<u8") for x in group.column("a")]
        successors = [unpacked(x.as_py(), "<u8") for x in group.column("e")]
        counts, own, follow, n = take("b", "<u8"), take("c", "<u4"), take("d", "<u4"), take("f", "<u4")
        start = np.cumsum([0, *map(len, contexts)])
        of = np.concatenate([np.repeat(np.arange(a, a + len(f)), f) for a, f in zip(start, follow, strict=False)])
        trie, found, after = build_trie(np.concatenate(contexts), np.concatenate(counts), np.concatenate(own), of, np.concatenate(successors), np.concatenate(n), discount)
        afters, steps = [], []
        for c, f, s in zip(contexts, follow, successors, strict=True):
            afters.append(packed(after[np.searchsorted(found, c)]))
            logs = trie.lookup(c, f, s)
            steps.append(np.where(np.isnan(logs), ABSENT, quantised(np.nan_to_num(logs))).astype("<u2").tobytes())
        k = len(runs_)
        return pa.table({"kind": pa.array([2] * k, pa.int32()), "run": pa.array(runs_, pa.int64()), "shard": pa.array([shard] * k, pa.int32()), "a": pa.array(afters, pa.binary()), "b": pa.array(steps, pa.binary())})

    answers = written(asked.groupBy("shard").applyInArrow(answer, "kind int, run long, shard int, a binary, b binary"), "lm-answers")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([Run(row, right, shards).score(right, tokens, distinct, discount) for row in left.to_pylist()] or [empty])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({"doc_id": pa.array([], to_arrow_type(id_type)), "held_out": pa.array([], pa.bool_()), **{x: pa.array([], pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    return runs.groupBy("run").cogroup(back.unionByName(answers).groupBy("run")).applyInArrow(finish, schema)
