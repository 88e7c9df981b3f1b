"""Connected components of an edge table by contraction: every round, each node merges into one neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinespark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b: bigint); nodes share a label if a path joins them.

    A round lets each node take, among itself and its neighbours, the one whose hash for this round is least,
    and replaces both ends of every edge by what they took.  Hashes change each round, so long paths
    shrink by a factor too; the number of rounds grows with the logarithm of the nodes.  Only minima are
    aggregated (combined before the shuffle), no neighbour list is gathered; each round is written.
    """
    edges = written(edges.filter("a != b").select("a", "b").distinct(), "edges")
    taken = []
    while not edges.isEmpty():
        seed = F.lit(len(taken))
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        best = F.min(F.struct(F.xxhash64("other", seed).alias("h"), F.col("other").alias("other")))
        took = both.groupBy("node").agg(best.alias("o")).select(
            "node", F.when(F.xxhash64("node", seed) < F.col("o.h"), F.col("node")).otherwise(F.col("o.other")).alias("label"))
        took = written(took, "took")
        taken.append(took)
        edges = (edges.join(took.toDF("a", "a2"), "a").join(took.toDF("b", "b2"), "b")
                 .filter("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        edges = written(edges, "edges")
    if not taken:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = taken[0]
    for took in taken[1:]:
        found = (found.join(took.toDF("label", "later"), "label", "left")
                 .select("node", F.coalesce("later", "label").alias("label")))
    return written(found, "labels")
