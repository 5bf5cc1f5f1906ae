"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import checkpointed


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of the edges ``u, v``; a component is named by its least node.

    Large-star and small-star steps alternate until the edges stay as they
    are, which takes a number of rounds logarithmic in the longest path. Only
    edges and minima move, and a node of very many edges meets just its own
    minimum. An empty table gives an empty result; edges from a node to
    itself and repeated edges are harmless.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        down = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = down.join(_mins(down), "u")
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(_mins(now).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
