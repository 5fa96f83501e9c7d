"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dropped, stored


def _digest(df: DataFrame):
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node reachable.

    edges: two bigint columns a, b; loops and repeats are allowed. Each round writes its edges to
    the shared folder, so lost executors cost one round and plans stay short. Rounds grow with the
    logarithm of a component's diameter; a round's work with the number of edges."""
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.where("a <> b").select(hi, lo).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        after = stored(_small_star(_large_star(now)), "edges")
        dropped(now)
        now, got = after, _digest(after)
        if got == seen:
            break
        seen = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
