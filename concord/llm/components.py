"""Connected components by randomised contraction, all in DataFrames.

Each round every node points at the member of its closed neighbourhood with the smallest per-round hash; edges are
rewritten to those targets and loops dropped. A constant share of nodes goes in every round whatever the shape of the
graph (long chains included), so rounds grow with the logarithm of the largest component. The first rounds go by the nodes
themselves, which settles the stars that most links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, scratch


PLAIN = 2  # rounds in which the smallest node is the smallest by itself: stars around it are done after one
CUT = 3  # rounds after which edges are written as files: a checkpoint keeps its plan's estimated size, which is cubed a round


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, root) for each node that occurs in an edge; one root for each connected component.

    Nulls at either end and loops are ignored. An empty edge table gives an empty result. Every round's edges, pointers
    and roots are checkpointed, nothing is collected.
    """
    spark = edges.sparkSession
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = durable(e)
    out, read = None, None
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        rank = lambda c, t=turn: F.struct((F.xxhash64(c, F.lit(t)) if t >= PLAIN else F.lit(0).cast("long")).alias("h"), c.alias("v"))
        ends = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        hop = durable(ends.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least("m", rank(F.col("a")))["v"].alias("root")))
        if out is None:
            out = hop
        else:  # followed round by round, so that no plan grows with the rounds
            step = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
            out = durable(out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = hop.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hop.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = e.join(left, "a").join(right, "b").where("ra <> rb")
        e, last = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), read
        if turn % CUT == CUT - 1:
            e.write.parquet(read := scratch(spark, "edges"))
            e = spark.read.schema(e.schema).parquet(read)
        else:
            e, read = durable(e), None
        if last:
            discard(spark, last)
    else:
        raise RuntimeError("components did not settle")
    if out is None:
        kind = edges.schema[a].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return out
