"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import stored


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: every larger neighbour of u moves to the least neighbour of u (or u itself)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: now v < u in every edge; u and its neighbours move to the least of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return (small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns u, v of one integral type); the root is the least node.

    Rows with u = v or nulls are ignored.  Every round is a written table in the checkpoint folder; the
    rounds end when one changes nothing (their number grows with the logarithm of the longest path).
    """
    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    before, state = None, fingerprint(now)
    while state != before and state[0]:
        now = stored(_star(now), "edges")
        before, state = state, fingerprint(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
