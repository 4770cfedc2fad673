"""Connected components by alternating stars, every round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage


def _is_flat(edges: DataFrame) -> bool:
    """Whether every edge points at a root: no node is below two others or both below and above."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("node"), F.lit(1).alias("below")),
                F.struct(F.col("lo").alias("node"), F.lit(0).alias("below")),
            )
        ).alias("e")
    ).select("e.*")
    odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return not odd.where("below > 1 OR (below = 1 AND least = 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b bigint).

    ``component`` is the smallest node that can be reached. Self loops and
    repeated edges add nothing, edges with a null end are left out, no edges
    give no rows. A node with a third of all edges is met by partial minima
    and by joins that Spark may split.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    while not _is_flat(current):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lower, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        current = stage(small.select("e.*").where("hi <> lo").distinct(), "edges")
    roots = current.select(F.col("lo").alias("node")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
