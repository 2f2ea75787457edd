"""Structured Streaming forms of the operators that keep state. Each agrees with its batch form once all input is in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.learning import HIGH, LOW
from tessera.sources.scratch import Store


def changes(spark: SparkSession, path: str, schema: str, most_files: int = 1000) -> DataFrame:
    """A folder's new files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once, while it is within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, key: str, ts: str = "ts", quiet: str = "200 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """One row for each burst of a key: a burst ends when nothing comes for the quiet time. Deletions count before changes."""
    bursts = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, quiet).alias("w"))
    return bursts.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("event_type") == "error").alias("deleted")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("ends"), "n", "deleted")


def learning_state(events: DataFrame, start: float = 0.5) -> DataFrame:
    """The clamped fold of reinforcement per key, kept across triggers: (key, weight, n)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        weight, n = state.get if state.exists else (start, 0)
        for pdf in batches:
            for kind in pdf.sort_values(["ts", "seq"]).kind:
                weight = weight + 0.15 if kind == "reinforce" else weight - 0.10 if kind == "penalise" else weight * 0.98
                weight = min(max(weight, LOW), HIGH)
                n += 1
        state.update((weight, n))
        yield pd.DataFrame({"key": [key[0]], "weight": [weight], "n": [n]})

    return events.groupBy("key").applyInPandasWithState(fold, "key long, weight double, n long", "weight double, n long", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there now."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert(changed: DataFrame, path: str, key: str, order: str) -> None:
    """foreachBatch body: the newest row of each key replaces the table's."""
    newest = changed.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in changed.columns]), order).alias("x")).select("x.*")
    store = Store(changed.sparkSession, path)
    held = store.read()
    store.replace(newest if held is None else held.join(newest.select(key), key, "left_anti").unionByName(newest))
