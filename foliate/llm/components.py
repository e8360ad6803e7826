"""Connected components of large edge tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node's least neighbour comes from a partial aggregate, and the join back can be split where a node is hot."""
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u > v holds in every edge: v are the smaller neighbours of u
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        linked = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges(u, v)`, a root being the least node that can be reached.

    Nodes are longs; loops and repeated edges are allowed, and an empty table gives an empty one. Each round is
    written to the shared folder; the rounds end when one changes nothing, which is seen from the count and an
    order-free checksum of the edges, so nothing but two numbers reaches the driver.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = written(_stars(_stars(now, True), False), "stars")
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
