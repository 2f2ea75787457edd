"""Exact dedup: counting quotient filters find fingerprints seen twice, bytes decide.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints, cut into
blocks by the highest bits. Blocks of all partitions merge without loss, one block a task, so
a text that a third of all rows share arrives as a counter. Only texts whose fingerprint
counts more than one go on to byte verification: they are grouped by their bytes, with
partial aggregation before the shuffle, so two texts with one fingerprint stay apart.

Defined results: a null text is empty, so nulls and empty texts are equal; of equal texts the
row with the largest doc_id stays; rows with a null doc_id never win over others; rows that
repeat a doc_id and its text are rows of one document and are flagged alike (`distinct` keeps
one of them, and one of several equal texts whose ids are all null); rows that repeat a doc_id
with different texts are judged by their texts; an empty table gives an empty result; extra
columns of any name are ignored, and kept by `distinct`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import cqf
from tessera.llm.common import fresh, pick, sized, text_or_empty, written

#: Distinct fingerprints that a block is to hold; blocks at most, as bits.
BLOCK_ROWS, MOST_BITS = 1 << 18, 14


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Of the one column of fingerprints, those that occur more than once: (fp, n)."""
    bits = min(MOST_BITS, max(6, int(np.ceil(np.log2(max(1, rows / BLOCK_ROWS))))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append(cqf.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            size += len(held[-1][0])
            if size >= 1 << 22:  # a very large partition gives several filters
                yield from blocks(cqf.merge(held))
                held, size = [], 0
        if held:
            yield from blocks(cqf.merge(held))

    def blocks(merged: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, counts = merged
        block = (found >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(block))
        data = [cqf.encode(found[a:b], counts[a:b], bits) for a, b in zip(first, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(data, pa.binary())], ["block", "filter"])

    def combine(part: pa.Table) -> pa.Table:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for value in part.column("filter"):
            waiting.append(cqf.decode(value.as_py()))
            if sum(len(f) for f, _ in waiting) > max(1 << 16, len(held[0])):
                held, waiting = cqf.merge([held, *waiting]), []
        found, counts = cqf.merge([held, *waiting])
        many = counts > 1
        return pa.table({"fp": pa.array(found[many].view(np.int64)), "n": pa.array(counts[many].astype(np.int64))})

    return prints.mapInArrow(partial, "block int, filter binary").groupBy("block").applyInArrow(combine, "fp long, n long")


def groups_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fp): the texts of two rows or more as (fp, text_sha256, keep_id, group_size)."""
    repeated = written(repeated_fingerprints(docs.select("fp"), docs.count()), "dedup-repeated")
    suspects = docs.join(sized(repeated.select("fp")), "fp", "left_semi")
    verified = (
        suspects.groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return written(verified.filter("group_size > 1"), "dedup-groups")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty()).withColumn("fp", F.xxhash64("text"))
    groups = groups_of(docs)
    rows = docs.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256"))
    joined = rows.join(sized(groups), ["fp", "text_sha256"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def distinct(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one for each text, with all their columns."""
    text = F.coalesce(df[f"`{text_col}`"], F.lit(""))
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty()).withColumn("fp", F.xxhash64("text"))
    fp, sha, keep, size = fresh(df, "fp", "sha", "keep", "size")
    groups = groups_of(docs).toDF(fp, sha, keep, size)
    marked = df.withColumns({fp: F.xxhash64(text), sha: F.sha2(text, 256)}).join(sized(groups), [fp, sha], "left")
    alone = F.col(f"`{size}`").isNull()
    kept = marked.filter(alone | F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{keep}`")))
    again = written(kept.filter(~alone).groupBy(fp, sha).count().filter("count > 1").select(fp, sha), "dedup-again")
    columns = [f"`{c}`" for c in df.columns]
    if again.isEmpty():
        return kept.select(columns)
    once = kept.join(sized(again), [fp, sha], "left_anti").select(columns)
    return once.unionByName(kept.join(sized(again), [fp, sha], "left_semi").dropDuplicates([fp, sha]).select(columns))
