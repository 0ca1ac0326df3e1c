"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stored


def components(edges: DataFrame, name: str, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps: each node points its neighbours at the smallest one it knows, until
    nothing changes; the number of rounds is about the logarithm of a component's size. Minima are pre-aggregated
    before each shuffle and joined back, so a node with very many neighbours is split like any skewed join. Each round
    is written to the shared folder; nothing but two sums reaches the driver. Self-links and null ends are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        past, now = now, stored(star, name)
        discard(past)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds")
