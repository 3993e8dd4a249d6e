"""Connected components of an edge table by alternating star operations: a few rounds of joins, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.llm.scratch import discard, keep


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are tied to the least of the node and its neighbours.

    The least ones are written first: a join of two plain shuffles can split the many edges of one node, which it
    can't where one side is summed up in the same stage.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for all nodes of ``edges`` (u, v), in either order.

    Loops and repeated edges don't matter; no edges give no rows. The tables of a round are deleted after the next.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = keep(ordered, "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while True:
        large, one = _large(now)
        small, two = _small(large)
        old, now = now, keep(small, "edges")
        discard(old, one, two)
        if (after := mark(now)) == before:
            break
        before = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return keep(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "components")
