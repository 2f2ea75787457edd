"""Connected components of an undirected link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) ids. (id, component) for every id that has a link; the component is its smallest id.

    Each round points every id at the smallest id among its neighbours, from above and from below; rounds grow with the
    logarithm of the longest path. Rounds are written to the shared folder. A hub's neighbours are reduced before the
    shuffle and joined back by a join whose skew Spark splits.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: neighbours above an id go to the smallest around it
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.filter("m < u").select("u", "m"))
        large = written(large.filter("u <> v").distinct(), "links")
        # small star: neighbours below an id go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        fresh = written(small.filter("u <> v").distinct(), "links")
        after = digest(fresh)
        discard(edges)
        discard(large)
        edges = fresh
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
