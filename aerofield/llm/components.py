"""Connected components of an edge table by alternating stars."""
from pyspark.sql import DataFrame, functions as F

from aerofield.session import materialized


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each first node's smallest partner.  Written out, so that the join with it is a
    plain one that adaptive execution can split at a hub."""
    return materialized(pairs.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node of
    ``edges(a, b)``; loops and repeated edges do no harm, nulls are ignored.

    Large star: every larger neighbour of a node is tied to the node's smallest
    neighbour; small star: every smaller one.  The tree depth halves or better in
    each round, rounds are cut by written tables, and only a count and a checksum
    come to the driver."""
    state = materialized(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = materialized(
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        low = _lowest(large)
        tied = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        state = materialized(tied.select("e.u", "e.v").where("u <> v").distinct(), "small")
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
